import random

import brute
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import secretscan, tokens


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "ration", "Ble", "thing", "and,", "état"]) + str(r.randrange(30)) for _ in range(n))


def test_stages_against_brute_force(spark, documents):
    passage = prose(40, 999)
    rows = [(k, prose(60, k)) for k in range(1000, 1300)]
    rows = [(k - 1000, t) for k, t in rows]
    rows += [(400 + k, " ".join(w + "%%%" for w in prose(60, 500 + k).split(" "))) for k in range(60)]
    rows += [(600, rows[3][1]), (601, rows[4][1] + " tail"), (602, prose(60, 77) + " " + passage), (606, prose(3000, 76) + " " + " ".join(passage.split(" ")[9:23]) + " " + prose(50, 75)), (603, prose(150, 78) + " token = abcdef0123456789abcd"), (604, None), (605, "")]
    labels = [(k, 1) for k in range(0, 300, 2)] + [(400 + k, 0) for k in range(0, 60, 2)]
    path = documents(rows, benchmark={"item_id": pa.array([1], pa.int64()), "text": pa.array([passage])}, labels={"doc_id": pa.array([d for d, _ in labels], pa.int64()), "quality": pa.array([q for _, q in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())})
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path), name)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    texts = dict(rows)
    quality, near, clean, redacted = kept
    good, junk = set(range(300)) & set(quality), set(range(400, 460)) & set(quality)
    assert len(good) >= 285 and len(junk) <= 3, (len(good), len(junk))
    classes = brute.jaccard_classes(sorted(quality.items()), 5, 80)
    assert set(near) == {doc for doc, _, least in classes if doc == least} and not {600, 601} & set(near)
    assert set(clean) == {r[0] for r in brute.decontaminated(sorted(near.items()), [(1, passage)]) if not r[2]} and not {602, 606} & set(clean)
    assert all(clean[d] == texts[d] for d in clean) and set(redacted) == set(clean)
    assert 603 not in redacted or "[assign]" in redacted[603]
    assert not any("abcdef0123456789abcd" in t for t in redacted.values()) and all(secretscan.scan_text(t, 200)[4] == "" for t in redacted.values())
    whole, want = Tokenizer.from_file(tokens.default_path()), []
    for doc, text in redacted.items():
        ids = brute.tokens(whole, text, 0)
        want += [(doc, k // 2048, len(ids[k : k + 2048]), brute.crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, empty and long texts, and columns with the operators' own names."""
    passage = prose(40, 999)
    rows = [(1, prose(80, 1)), (1, prose(80, 1)), (None, prose(80, 2)), (None, prose(80, 2) + " tail"), (None, None), (2, None), (3, ""), (4, prose(40_000, 3)), (5, prose(60, 4) + " password = abcdefgh12345678"), (None, passage), (6, prose(80, 5)), (7, prose(80, 5))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` long, label string, part int, score double"
    full = [(d, t, "en", None, len(t or ""), k, "x", 1, None) for k, (d, t) in enumerate(rows)]
    for name, data, kind in (("benchmark", [(1, passage), (None, None), (2, "")], "item_id long, text string"), ("labels", [(1, 1, 0), (6, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for case in ([], full):
        docs = spark.createDataFrame(case, schema)
        columns, before = docs.columns, {r["a.b"] for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == columns, name
            after = {r["a.b"] for r in docs.collect()}
            assert after <= before and len(after) == docs.count(), name
            if case and name == "ngram_jaccard_join":  # one of each group of copies, rows without words as they are
                assert len(after & {0, 1}) <= 1 and len(after & {2, 3}) <= 1 and len(after & {10, 11}) <= 1
            before = after
        assert 9 not in before and all("abcdefgh12345678" not in (r["text"] or "") for r in docs.collect())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
        if case:
            assert 4 in {r["doc_id"] for r in docs.collect()}
