"""Fill-in-middle against a plain form of its rule, exact round trips, odd rows."""

import hashlib

from loomspark.llm import middle

TEXTS = ["", None, "a", "ab", "Größe 🙂 und é mehr", "<P>", "has <S> inside", "<M", "x<", "<<P", "line\r\nline \x00end", "<S<P<M", "y" * 3000, "é🙂" * 5000]


def plain_form(doc_id, text):
    """The rule, unit by unit."""
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i * 8 : i * 8 + 8], 16) for i in range(4)]
    units = list(text)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = h[0] % (len(units) + 1), h[1] % (len(units) + 1)
    a, b = min(a, b), max(a, b)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_every_row_follows_the_rule_and_is_restored(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "n", 7) for i in range(40 * len(TEXTS))] + [(None, "no id", "", 0), (3, "again", "", 0), (3, "again", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output int")
    made = middle.fill_in_middle(docs)
    got = made.select("*", middle.restored(made.output, made.form).alias("back")).collect()
    want = sorted(((i, *plain_form(i, t), t or "") for i, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_type_of_id(spark):
    made = middle.fill_in_middle(spark.createDataFrame([], "doc_id int, text string"))
    assert made.count() == 0 and made.schema["doc_id"].dataType.simpleString() == "int"


def test_long_texts_are_matched_in_runs(spark):
    import regex

    pattern, text = regex.compile(f"({middle.CODE_POINT})*"), "aé🙂\n" * 700
    assert middle.unit_ends(text, pattern, 17) == middle.unit_ends(text, pattern, None) == list(range(1, len(text) + 1))
    long = "à la " * 400_000
    row = middle.fill_in_middle(spark.createDataFrame([(5, long)], "doc_id long, text string")).first()
    assert tuple(row)[1:] == plain_form(5, long)


def test_other_units(spark):
    docs = spark.createDataFrame([(i, "un mot\nautre  ligne\nfin éé") for i in range(60)] + [(100, " "), (101, "")], "doc_id long, text string")
    words = middle.fill_in_middle(docs, unit=r"\s*\S+\s*", seed="2", rate=100, suffix_first=50)
    rows = words.select("*", middle.restored(words.output, words.form).alias("back")).collect()
    ends = {0, 3, 7, 14, 20, 24, 28}
    for r in rows:
        if r.doc_id < 60:
            assert r.n == 6 and r.form != "plain" and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends | {len(r.back)}
        else:
            assert r.form == "plain" and r.n == (0 if r.doc_id == 101 else None)
    graphemes = middle.fill_in_middle(docs, unit=r"\X").where("doc_id < 60").first()
    assert graphemes.n == len("un mot\nautre  ligne\nfin ee")
    assert {r.form for r in middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    made = middle.op13_fill_in_middle(spark, sf)
    want = con.sql(middle.ORACLE)
    assert made.columns == want.columns
    assert sorted(tuple(r) for r in made.collect()) == sorted(want.fetchall())
