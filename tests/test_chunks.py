"""Chunks by chapters, scenes and size, the same on a batch and on a stream."""

from graphloom.operators.chunks import discourse_chunks, filled, slug, units
from graphloom.streaming import windows


def test_units_know_their_chapter():
    text = "Intro here. And so on.\n\n# Chapter II: The End\nFirst line\ngoes on.  Then more!\n    \"Said so.\" He left.\n* * *\nPart of it stays.\nDocument [3]: has text. Here.\nprologue\nlast"
    found = [(text[a:b], n, c) for a, b, n, c, _ in units(text)]
    assert found == [
        ("Intro here.", 2, None), ("And so on.", 3, None), ("First line\ngoes on.", 4, "chapter_ii_the_end"), ("Then more!", 2, "chapter_ii_the_end"), ('"Said so."', 2, "chapter_ii_the_end"), ("He left.", 2, "chapter_ii_the_end"),
        ("* * *", -1, "chapter_ii_the_end"), ("Part of it stays.", 4, "chapter_ii_the_end"), ("has text.", 2, "document_3"), ("Here.", 1, "document_3"), ("last", 1, "prologue"),
    ]
    assert slug("Epilogue – An end!") == "epilogue_an_end" or slug("Epilogue - An end!") == "epilogue_an_end"


def test_filling():
    unit = lambda n, chapter=None: (0, 1, n, chapter, None)
    sizes = lambda found: [[u[2] for u in c] for c in filled(found, 10)]
    assert sizes([unit(4), unit(6), unit(1), unit(10), unit(2), unit(-1), unit(3), unit(12), unit(2), unit(2, "b")]) == [[4, 6], [1], [10], [2], [3], [12], [2], [2]]
    assert sizes([]) == sizes([unit(-1)]) == []


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, "\n".join(f"Chapter {j}\n" + f"Word {k}. " * (30 * k) for j in range(3))) for k in range(6)] + [(None, "A text."), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stages = (lambda c: c.where("words > 0"), lambda c: c.select("doc_id", "chunk", "chapter", "words"))
    stream = windows.chunk_pipeline(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), *stages)
    query = stream.writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "c")).start()
    assert windows.drained(query)["rows"] == len(rows)
    query.stop()
    want = windows.chunk_pipeline(docs, *stages).collect()
    assert sorted(map(repr, map(tuple, spark.table("chunked").collect()))) == sorted(map(repr, map(tuple, want))) and len(want) == 16
    assert all(r["words"] <= 350 for r in want)
    assert discourse_chunks(docs, 20).where("words > 20").count() == 0
