import os

from docveil.plans import pipeline
from pyspark.sql import functions as F

from docveil.sinks import pdf_writer
from docveil.sources import listing, pdf
from docveil.sources.pdf_objects import Document
from docveil.streaming import watch
from tests import pdfs

PAGE = pdfs.text("Rapport", size=30, y=750) + pdfs.text("Contact: x@y.com, et", y=700) + pdfs.text("suite du texte.", y=688) + pdfs.text("Fin le 01/02/2024 ?", y=600)


def text_of(data: bytes) -> str:
    return "".join(x["value"] for x in pdf.document_letters(data))


def put(folder, name: str, data: bytes) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_run_writes_both_outputs(spark, tmp_path):
    deep = tmp_path / "in" / "deep"
    put(deep, "a.pdf", pdfs.pages(PAGE, pdfs.text("page deux", y=700)))
    put(deep, "bad.pdf", b"junk")
    put(deep, "done.pdf", pdfs.pages(PAGE))
    put(deep, "done.anon.pdf", b"junk")
    # the second page can't be interpreted, and a file without letters: nothing is written for either
    put(deep, "half.pdf", pdfs.pages(pdfs.text("mail a.b@c.org"), b"BT /F1 10 Tf 5 Td (x) Tj ET"))
    put(deep, "blank.pdf", pdfs.pages(b"0 0 10 10 re f"))
    assert pipeline.run(spark, [str(tmp_path / "in"), str(deep), str(deep / "a.pdf")]) == {"markdown": 1, "pdf": 1, "errors": 3}
    assert sorted(p.name for p in deep.glob("*.anon.*")) == ["a.anon.md", "a.anon.pdf", "done.anon.pdf"]
    out = (deep / "a.anon.pdf").read_bytes()
    assert b"x@y.com" not in b"".join(Document(out).content(p) for _, p in Document(out).pages())
    assert "suite du texte." in text_of(out) and "x@y.com" not in text_of(out) and "01/02/2024" not in text_of(out)
    shown = (deep / "a.anon.md").read_text(encoding="utf-8")
    assert shown.startswith("# a (anonymisé)\n\n_Export") and "*Page 1*\n\n## Rapport\n\n" in shown
    assert "Contact: ████████ et suite du texte.\n\n" in shown  # the whole word, comma included
    # a question mark closes no paragraph, and paragraphs run across pages
    assert "Fin le ██████████ ? page deux\n\n" in shown
    # everything is done now
    assert pipeline.run(spark, [str(tmp_path / "in")])["pdf"] == 0


def test_errors_of_every_stage(spark, tmp_path, monkeypatch):
    from docveil.operators import ner

    put(tmp_path, "a.pdf", pdfs.pages(PAGE))
    put(tmp_path, "b.pdf", b"junk")

    def no_model():
        def score(ids, mask):
            raise RuntimeError("no model")

        from tokenizers import Tokenizer, models, pre_tokenizers

        tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
        tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
        return score, tokenizer, ["O"]

    def faces(files):
        return files.select(F.col("path").alias("doc"), F.lit(1).alias("obj_id"), F.lit(False).alias("has_face"), F.when(F.col("path").endswith("a.pdf"), "no picture").alias("error"))

    todo = listing.with_content(listing.listed(spark, [str(tmp_path)]))
    out = pipeline.redact_files(todo, lambda p: ner.ner_spans(p, ["doc", "para_no"], no_model), faces)
    got = {(r.doc.rsplit("/", 1)[1], r.stage) for r in out["errors"].collect()}
    assert got == {("a.pdf", "ner"), ("b.pdf", "read"), ("a.pdf", "faces")}
    assert [r.doc.rsplit("/", 1)[1] for r in out["pdf"].where("content is not null").collect()] == ["a.pdf"]
    # a folder that isn't there can't be written to
    state = pdf_writer.write_files(spark.createDataFrame([(str(tmp_path / "none" / "x.pdf"), bytearray(b"x"), None), ("y.pdf", None, "broken")], "path string, content binary, error string"))
    assert {r.doc.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in pdf_writer.failures(state, "pdf").collect()} == {"x.pdf": "FileNotFoundError", "y.pdf": "broken"}
    assert pdf_writer.written_files(state) == 0


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "first.pdf", pdfs.pages(PAGE))
    assert watch.start(spark, str(tmp_path / "missing"), str(tmp_path / "c")) is None
    watch.start(spark, str(folder), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert (folder / "first.anon.pdf").exists()
    put(folder, "second.pdf", pdfs.pages(PAGE))
    before = (folder / "first.anon.pdf").stat().st_mtime_ns
    seen = []
    query = watch.start(spark, str(folder), str(tmp_path / "c"), once=True, handle=lambda todo: seen.append(sorted(r.path.rsplit("/", 1)[1] for r in todo.select("path").collect())))
    query.awaitTermination(120)
    assert ["second.pdf"] in seen and all("first.pdf" not in x for x in seen)
    assert (folder / "first.anon.pdf").stat().st_mtime_ns == before


def test_stream_of_texts(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.com now"), (2, None)], "id int, text string").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "t"))
    query = watch.masked_stream(stream, ["id"]).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.id: r.masked_text for r in spark.sql("select * from masked").collect()} == {1: "mail ███████ now", 2: None}


def test_masked_texts(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "x@y.com, a"), (5, "06 12  34 56 78 ok"), (6, "no find"), (7, "a@b.com c@d.com"), (8, "Léa@ a@b.com" + " word" * 3000), (8, "dup")]
    df = spark.createDataFrame(rows, "masked_text int, text string")
    got = {(r[0], r[2], r[3], r[1] if r[1] is None or len(r[1]) < 40 else len(r[1])) for r in pipeline.masked_texts(df.withColumnRenamed("masked_text", "id"), ["id"]).collect()}
    assert got == {
        (1, 0, 0, None), (2, 0, 0, ""), (3, 0, 0, "   "), (4, 1, 2, "████████ a"), (5, 5, 1, "██ ██  ██ ██ ██ ok"), (6, 0, 0, "no find"), (7, 2, 4, "███████ ███████"), (8, 1, 2, 15012), (8, 0, 0, "dup"),
    }
