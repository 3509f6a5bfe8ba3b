"""Counts of a run: those of its tables, without a scan of their own."""

from pyspark.sql import functions as F

from loomspark import api
from loomspark.operators import progress


def test_counts_are_those_of_the_tables(spark, tmp_path):
    for name, body in {"a/README.md": "# A\n\nSee [two](docs/two.md).", "a/docs/two.md": "# Two\n\nText.", "b.txt": "some text", "bad.docx": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    run = progress.Run()
    docs, sources, errors = api.ingest(spark, [str(tmp_path / n) for n in ("a", "b.txt", "bad.docx")], run=run)
    assert {f"source_{r.ord}": r.documents for r in sources.collect()} | {"source_2": 0, "rows": 3} == dict(run.seen[0][1])
    assert run.count("sources_failed") == errors.count() == 1
    made = api.generate(docs, "2024-05-01", run=run)
    found = made.checks()
    assert run.count("files_made") == made.files.count() and run.count("concepts_made") == made.concepts.count() == 3
    assert run.count("files_made", "characters") == made.files.agg(F.sum(F.length("content"))).first()[0]
    assert (run.count("checked"), run.count("checked", "errors"), run.count("checked", "warnings")) == (found.count(), 0, found.where("not passed").count())
    events = made.run.events(spark)
    assert [r.event for r in events.where("metric = 'rows'").orderBy("seq").collect()] == ["documents_read", "sources_failed", "documents_parsed", "concepts_made", "files_made", "checked"]


def test_no_rows(spark):
    run = progress.Run()
    run.written(spark.range(0), "none", total=F.sum("id"))
    assert run.seen == [("none", {"rows": 0, "total": 0})] and progress.Run().events(spark).count() == 0
