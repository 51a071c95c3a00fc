"""The registered queries, and the pipeline against plain versions of its stages."""

import hashlib

import brute
import public_tokenizers
import pytest
from brute import pairs
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import decontaminate, queries, toxicity

COLUMNS = {
    "op1": {"page_id", "url", "text", "n_chars"}, "op2": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op3": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op5": {"doc_id", "n_shingles", "component_id"}, "op6": {"doc_id", "held_out", "score", "predicted"}, "op7": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8": {"doc_id", "held_out", "lang_pred", "score"}, "op9": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op10": {"doc_id", "item_id"},
    "op11": {"word", "form", "root", "n", "n_near", "form_n"}, "op12": {"item_id", "rank", "doc_id", "score"}, "op13": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    if name.split("_")[0] not in ("op10", "op11", "op12"):
        assert df.count() == spark.read.parquet(f"{sf}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    from oracle import connect, same

    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    lexicon = toxicity.learn(docs, labels)
    automaton = lexicon.automaton()
    state = [(d, t) for d, t in pairs(docs) if toxicity._probability(toxicity.features(t or "", lexicon, automaton), lexicon) < 0.5]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in state:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 5}
    state = [(d, "\n".join(x for x in t.split("\n") if keeper.get(key(x), d) == d)) for d, t in state]
    state = [r for r, c in zip(state, brute.components(state, 5, 80)) if r[0] == c[2]]
    items = [decontaminate.folded(r["text"]) for r in benchmark.collect()]
    state = [(d, t) for d, t in state if not any(brute.edits(i, decontaminate.folded(t)) <= len(i) // 10 for i in items if i in decontaminate.folded(t))]
    out = corpus_pipeline.run(spark, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, t in state:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[d] = len(ids), sha(",".join(map(str, ids)).encode()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == want and len(out) == len(want)


def test_stage_rules(spark, sf):
    """Each stage on null and empty texts, null ids, ties and repeated rows: what its docstring says, all columns as they were."""
    same = "the same forty and more characters stand in each of these"
    rows = [(1, None), (2, ""), (4, same), (4, same), (3, same), (None, same), (5, "another text, one without any copy in this table")]
    docs = spark.createDataFrame([(d, t, None, "x", None if t is None else len(t), "own") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __leak_row string")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "bpe" or out.columns == docs.columns
        got[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) if name != "bpe" else sorted((r["n_tokens"] for r in out.collect()))
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert got["toxicity"] == got["line_dedup"] == got["decontamination"] == sorted(rows, key=str)
    assert got["ngram_join"] == sorted([rows[0], rows[1], rows[4], rows[6]], key=str)
    assert got["bpe"][:2] == [0, 0] and got["bpe"][2] > 0
    five = spark.createDataFrame([(d, same, None, "x", len(same)) for d in (1, 2, 2, 3, 4, 5, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.STAGES[1][1](spark, five, sf).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in kept) == sorted((str(d), same if d == 5 else "", 57 if d == 5 else 0) for d in (1, 2, 2, 3, 4, 5, None))


def test_stages_on_odd_tables(spark, sf, odd):
    for rows in (odd, odd.limit(0)):
        docs = rows
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert "doc_id" in out.columns and (i == 4 or out.columns == odd.columns)
            docs = corpus_pipeline.materialize(out, "test")
        docs.count()
