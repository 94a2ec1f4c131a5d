"""Awkward rows: nulls, blank and very long texts, ties, repeated rows and clashing names."""

LONG = "wörd " * 60_000 + "end"
TEXTS = [None, "", " ", "\n\t\x0b", "a", "A  b\tc", "a b c", "Same text here, twice.", "Same  text here,\ntwice.", "ünïcödé 漢字 🙂   x y", "x" * 5000, LONG,
         "# * $ % & | < > !", "one two three four five six seven eight nine ten eleven", "l1\nl1\n\nl1 \n l1", "Same text here, twice.", "<|endoftext|> it's  we'll\r\n"]
CLASH = "row long, node long, digest string, size long, keep_id long, shard int, fp long, n_words long, kept string, before long, total long"


def awkward(spark):
    """Documents table with extra columns; doc_ids repeat and are null, whole rows repeat."""
    rows = []
    for k, text in enumerate(TEXTS):
        doc_id = None if k % 7 == 3 else 100 - 3 * (k % 11)
        rows.append((doc_id, text, [None, "en", "de"][k % 3], [None, "a", "B", "é"][k % 4], None if k % 5 else k) + (k, None, "d", 1, None, 2, 3, 4, "no", 5, 6))
    rows += rows[4:7]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(3).cache()


def empty(spark):
    return awkward(spark).limit(0)


def order(values):
    return sorted(values, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
