"""The pipeline, stage by stage, against plain Python on its own input."""

import os

import corpus_pipeline
from recordloom.llm import ngram_join, quality, secrets, textkit, tokens
from recordloom.llm import packing as P

from .test_exact import PLAIN, base_spans, linked, removed, rule_statistics, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.fit(quality.measure(docs), spark.read.parquet(f"{SF}/labels.parquet"))
    before = {r["doc_id"]: r for r in docs.collect()}
    for (name, stage), kind in zip(corpus_pipeline.STAGES, ("quality", "near", "substring", "secrets", "packing")):
        docs = textkit.written(stage(spark, docs, SF), "stage")
        if kind == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        rows = [(i, r["text"]) for i, r in before.items()]
        if kind == "quality":
            import pyarrow as pa

            base, features = quality.statistics(pa.array([t for _, t in rows]))
            assert [tuple(b) for b in base.tolist()] == [(s[0], s[1], s[2], s[3], s[4]) for s in (rule_statistics(t) for _, t in rows)]
            _, kept = model.judge(base, features)
            assert set(after) == {i for (i, _), k in zip(rows, kept) if k} and len(after) < len(before)
        elif kind == "near":
            assert set(after) == {i for i, (_, _, least) in linked(rows).items() if least == i}
        elif kind == "substring":
            want = removed(rows)
            assert all(after[i]["text"] == (t if not want[i][1] else want[i][2]) for i, t in rows) and len(after) == len(before)
        else:
            assert set(after) == set(before)
            for i, t in rows:
                assert base_spans(t) == "" or (after[i]["text"] != t and base_spans(after[i]["text"]) == "")
                assert after[i]["text"] == t or secrets.find(__import__("pyarrow").array([t]))[0]
        assert all(r["n_chars"] == len(r["text"]) for r in after.values() if kind in ("substring", "secrets"))
        before = after
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path(PLAIN))
    windows = check_packing(docs, {i: t.encode(r["text"] or "", add_special_tokens=False).ids for i, r in before.items()})
    assert sum(sum(r["length"] for r in w) == P.WINDOW for w in windows.values()) >= len(windows) - 14


def test_entry_points_register_everything():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_rows(spark, tmp_path):
    """Empty tables go through every stage."""
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " end"), (3, c), (4, c), (5, "alone in this table"), (6, None), (7, a + " x"), (8, "twice " * 3 + b[::-1]), (8, "twice " * 3 + b[::-1]), (None, a)]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(at)
    docs = spark.read.parquet(at)
    counts = sorted((r["doc_id"], r["n_similar"], r["component_id"]) for r in ngram_join.links(docs).collect() if r["doc_id"] is not None)
    assert counts == [(1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 1, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 2, 1), (8, 1, 8), (8, 1, 8)]
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (5, "alone in this table"), (6, None), (8, "twice " * 3 + b[::-1]), (None, a)]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in want)


def test_linked_rows_are_written_once(spark, tmp_path, monkeypatch):
    """No table is copied; what the stage writes in between is gone once it has its answer."""
    tables, own = [], textkit.written
    monkeypatch.setattr(textkit, "written", lambda df, what, at=None: tables.append(what) or own(df, what, at))
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, a), (2, a + " end"), (3, b), (3, a), (None, a)], "doc_id long, text string").repartition(2).write.parquet(at)
    shared = textkit.shared_dir(spark).removeprefix("file://")
    before = {*os.listdir(shared)}
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(at), str(tmp_path))
    assert [t for t in tables if t.startswith("linked")] == ["linked-documents"]
    assert not [p for p in {*os.listdir(shared)} - before if p.startswith(("linked", "shingle"))]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, a), (1, a), (3, b)]


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    """Every stage takes them, and all but the last give back the columns they got."""
    words = [f"plain{k} words{k % 97} here{k % 13}" for k in range(400)]
    long = " ".join(words * 3 + [f"only{k}" for k in range(40_000)])
    base = " ".join(words[:60])
    rows = [(1, base), (1, base), (2, None), (None, base), (None, None), (3, long), (4, ""), (5, " ".join(words[70:130]) + " password = abcdefghijklmnop"), (6, base.upper())]
    table = [(i, t, "en", None, 7, "mine", 1, "k", 0) for i, t in rows]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, text_key string, shard int").repartition(3).write.parquet(at)
    spark.createDataFrame([(k, 1, 0) for k in range(1, 7)] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(at)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = textkit.written(stage(spark, docs, str(tmp_path)), f"stage-{k}")
        assert docs.columns == columns and docs.where("n_words <> 'mine' or kept <> 1 or shard <> 0").isEmpty()
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((i or 0) for i, _ in left) == [0, 1, 3, 5] and "[SECRET]" in dict(left)[5]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in left}
