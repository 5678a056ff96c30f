"""Rows that each text operator has to stand: nulls anywhere, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))


def odd_documents():
    rows = [
        (1, "Alpha beta gamma delta.\nAlpha beta gamma delta.", "en", "a", 10),
        (2, "alpha BETA gamma delta.\nalpha beta gamma delta.", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \t\n", None, "b", 3),
        (6, LONG, "en", "a", len(LONG)),
        (7, LONG, "en", "b", len(LONG)),
        (8, "ÄÖÜ é ñ  two  spaces <|endoftext|> x", "de", "b", 30),
        (8, "ÄÖÜ é ñ  two  spaces <|endoftext|> x", "de", "b", 30),
        (None, "no id at all here", "en", "c", 17),
        (None, "no id at all here", "en", "c", 17),
        (9, "äöü É ñ", "fr", "c", 7),
    ]
    return rows + [(100 + i, " ".join(f"w{(i * 7 + j * j) % 501}" for j in range(40 + i)), ("en", "de")[i % 2], "abc"[i % 3], None) for i in range(40)]


def odd_frame(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


#: Extra columns with the names that the operators' results use.
CLASHING = ("kept", "h", "sha", "fp", "key", "size", "shard", "slot", "bucket", "n_words", "measures", "root", "component_id", "group", "length", "words", "html_text", "target", "taken", "mix_src", "lost_id", "rh", "draw", "name", "norm")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
