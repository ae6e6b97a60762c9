"""The pipeline's first and last stage with labels of both kinds."""

import random
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def mixed(n=160):
    """Texts of two kinds, a few of them odd, and labels of most."""
    r = random.Random(17)
    good = lambda: " ".join(r.choice(["the", "river", "flows", "over", "old", "stones", "and", "sings"]) for _ in range(r.randint(20, 90))) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "click###", "WIN", "xxx***"]) for _ in range(r.randint(20, 90)))
    docs = [(i, good() if i % 3 else bad()) for i in range(n)] + [(1000, None), (1001, ""), (None, good()), (5, bad())]
    labels = [(i, int(i % 3 != 0), 0) for i in range(n) if i % 7]
    return docs, labels


def test_quality_drops_what_the_classifier_rejects(spark, tmp_path):
    import corpus_pipeline
    from framelake.llm.quality import quality_scores

    docs, labels = mixed()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality(spark, df, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    scored = quality_scores(df, spark.read.parquet(f"{tmp_path}/labels.parquet").select("doc_id", "quality"), cutoff=corpus_pipeline.CUTOFF).collect()
    key = lambda x: (str(x["doc_id"]), str(x["text"]))
    assert sorted(map(key, kept.collect())) == sorted(key(x) for x in scored if x["predicted"] == 1)
    clean, held = {d for d, t in docs if d is not None and d < 1000 and d % 3 and d != 5}, {x["doc_id"] for x in kept.collect()}
    assert clean <= held and not {d for d in range(160) if d % 3 == 0} & held
    out = [x for x in scored if x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert all(x["held_out"] for x in out) and len(out) > 10


def test_packed_sequences_hold_every_token_once(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, _ = mixed(40)
    docs = [(d, t) for d, t in docs if d is not None and d != 5] + [(5, "stones " * 9000)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], SCHEMA)
    rows = corpus_pipeline.packing(spark, df, str(tmp_path)).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in docs}
    for d, n in want.items():
        at = sorted((x["start"], x["length"]) for x in rows if x["doc_id"] == d)
        assert at[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(at, at[1:])) and sum(at[-1]) == n
    fill = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == fill.get(x["sequence_id"], 0)
        fill[x["sequence_id"]] = x["offset"] + x["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values())
    assert max(fill.values()) <= 2048 and padding < 2048
