from pyspark.sql import functions as F

from tidemart import functions as fn


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalize_text(spark):
    cases = {  # one for each step, then several at once
        "Ünïcödé": "unicode", "e\u0301\u0327": "e", "\u212a and \u212b": "k and a", "\u1e9b\u0323x": "x", "a´b¸c": "a b c", "a`b^c": "a b c", "10€ ½ 漢字 z": "10 z", "a--b__c!!": "a b c",
        "  MiXeD  ": "mixed", "": None, " -!- ": None, "漢": None, "Ça va, l´été?": "ca va l ete",
    }
    got = values(spark, [(k,) for k in cases], "t string", fn.normalize_text(F.col("t")))
    assert dict(zip(cases, got)) == cases
    assert values(spark, [(None,)], "t string", fn.normalize_text(F.col("t"))) == [None]


def test_every_decomposed_letter_loses_its_marks(spark):
    import unicodedata

    letters = [chr(c) for c in range(0x80, 0x30000) if unicodedata.decomposition(chr(c)) and not 0xD800 <= c < 0xE000]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    got = values(spark, [(c,) for c in letters], "t string", fn.text.strip_accents(F.col("t")))
    off = [c for c, g in zip(letters, got) if len(plain(c)) == 1 and unicodedata.category(unicodedata.normalize("NFD", c)[0]) != "Mn" and g != plain(c)]
    assert not off and got[letters.index("\u212a")] == "K"


def test_names_fences_and_sizes(spark):
    assert values(spark, [("A.b.C",), ("b.C",), ("C",)], "t string", fn.qualified_name(F.col("t"))) == ["b.c", "b.c", "c"]
    assert values(spark, [("say ```SQL\n select 1 \n``` or ```x```",), (" select 2\n",), ("```\na\nb```",)], "t string", fn.strip_fences(F.col("t"))) == ["select 1", "select 2", "a\nb"]
    assert values(spark, [(0,), (1023,), (1280,), (1 << 20,), (5 << 40,), (1 << 60,)], "n long", fn.human_bytes(F.col("n"))) == ["0.0 B", "1023.0 B", "1.2 KiB", "1.0 MiB", "5.0 TiB", "1048576.0 TiB"]
    assert values(spark, [("abc",)], "t string", fn.fingerprint(F.col("t"))) == ["ba7816bf8f01cfea"]


def test_day_diff_counts_midnights(spark):
    rows = [("2024-01-01 23:59:00", "2024-01-02 00:01:00"), ("2024-01-02 00:00:00", "2024-01-01 23:00:00")]
    col = fn.day_diff(F.col("b").cast("timestamp_ntz"), F.col("a").cast("timestamp_ntz"))
    assert values(spark, rows, "a string, b string", col) == [1, -1]


def test_sets_and_vectors(spark):
    rows = [([], []), (["a"], ["a", "b"]), (["c"], ["d"])]
    assert values(spark, rows, "a array<string>, b array<string>", fn.jaccard(F.col("a"), F.col("b"))) == [1.0, 0.5, 0.0]
    rows = [([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])]
    assert values(spark, rows, "a array<float>, b array<float>", fn.cosine(F.col("a"), F.col("b"))) == [0.0, 1.0, None]


def test_ratio_and_wilson(spark):
    assert values(spark, [(1, 0), (1, 8)], "a int, b int", fn.ratio_or(F.col("a"), F.col("b"), None, 100, 2)) == [None, 12.5]
    low, high = spark.createDataFrame([(10, 10)], "k int, n int").select(*fn.wilson(F.col("k"), F.col("n"))).first()
    assert round(low, 4) == 0.7225 and round(high, 9) == 1.0
