"""Small tables with the odd rows every operator must take: nulls in any
column, empty and very long texts, ties, repeated rows, extra columns whose
names clash with the operators' own."""

PASSAGE = " ".join(f"word{i} passage" for i in range(30))

DOCS = [
    (1, "The quick brown fox, it's  here.\n\nAnd there \n again\t.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "en", "b"),
    (5, "The quick brown fox, it's here. And there again.", "en", "b"),
    (5, "The quick brown fox, it's here. And there again.", "en", "b"),
    (None, "Thequickbrownfox,it'shere.Andthereagain.", None, None),
    (6, "x" * 30_000 + " " + "12" * 5_000 + " \u3000\u00a0 é\u0301 \U0001f600 <|endoftext|> \x1c\x85end", "fr", None),
    (7, "start " + PASSAGE + " end of the first", "en", "a"),
    (8, "another beginning " + PASSAGE + " and a different ending", "en", "a"),
    (9, "ab" * 400, "de", "c"),
    (10, "1234 5678", "de", "c"),
    (-3, "mail a@b.c and x.y+z@mail.example.com, ip 10.0.0.1, 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 123-4567", "en", "c"),
    (11, "IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, phone (555) 123-4567, 555-123-4567", "en", "c"),
    (12, "\n".join(["same line here"] * 40 + ["three word window three word window"] * 3), "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, size string, gram int, fp string, spans string, bucket string"


def documents(spark, rows=None):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", 1, "w", "v", "u") for r in (DOCS if rows is None else rows)], SCHEMA)


BIG = "<p>" + "payload " * 200 + "</p>"
PAGES = [
    (1, "http://A.example.NET/en/1?q=/x#y", BIG),
    (2, "https://www.example.com/de/x", BIG),
    (7, "https://www.example.com/de/x", BIG),
    (7, "https://www.example.com/de/x", BIG),
    (None, "nothing", BIG),
    (3, None, None),
    (4, "http://x.org/fr/1", ""),
    (5, "http://x.org?fr/1", "small"),
    (6, "http://bad\r\nX-Injected: 1/", "small \r\n\r\nWARC/1.1\r\n é"),
    (8, "http://the.fox.org/en/", BIG + "é"),
    (9, "a://b://c/d", None),
]


def pages(spark, rows=None):
    return spark.createDataFrame([(*r, "x", "y") for r in (PAGES if rows is None else rows)], "page_id long, url string, html string, id string, digest string")


def as_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))
