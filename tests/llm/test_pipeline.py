"""The pipeline's rows against brute-force versions of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm.test_mixing import water, words
from tests.llm.test_langid import brute_language
from tests.llm.test_pii import brute
from tests.llm.test_similar import brute_groups, brute_set
from vecloom.llm import langid, pieces, pii


def test_stages(spark, docs, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "personal_data", "mix_sources", "sentencepiece"]
    kept, frames = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, sf_dir), "test-stage")
        assert kept.columns == docs.columns
        frames.append(kept)
    language, unique, clean, mixed = ([r.asDict() for r in f.collect()] for f in frames)

    model = langid.fit(docs, ~langid.held_out())
    by_hand = {r["doc_id"]: brute_language(model, r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["lang"] for r in language} == {k: v[0] for k, v in by_hand.items() if v and v[2]}

    first = brute_groups([brute_set(r["text"]) for r in language])
    groups = {}
    for r, g in zip(language, first):
        groups[g] = min(r["doc_id"], groups.get(g, r["doc_id"]))
    assert sorted(r["doc_id"] for r in unique) == sorted(groups.values())

    assert [r["doc_id"] for r in sorted(clean, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in unique)
    before = {r["doc_id"]: r["text"] for r in unique}
    for r in clean:
        assert not brute(r["text"]) and r["n_chars"] == len(r["text"])
        # without terms that disclose (none in this table) the text with each span's kind in its place
        shown, at = "", 0
        for start, kind, end in brute(before[r["doc_id"]]):
            if start >= at:
                shown += before[r["doc_id"]][at:start] + f"<{pii.KINDS[kind]}>"
            at = max(at, end)
        assert r["text"] == shown + before[r["doc_id"]][at:]

    totals, taken, size = Counter(), Counter(), {r["doc_id"]: words(r["text"]) for r in clean}
    for r in clean:
        totals[r["source"]] += size[r["doc_id"]]
    for r in mixed:
        taken[r["source"]] += size[r["doc_id"]]
    for s, target in water(dict(totals)).items():  # whole documents: off by less than the largest
        assert abs(taken[s] - target) <= max(size[r["doc_id"]] for r in clean if r["source"] == s)

    got = corpus_pipeline.run(spark, sf_dir).collect()
    tool = pieces.codec(pieces.model_path())
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in mixed)
    for r in got:
        assert r["ids"] == tool.library.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == pieces.sha(tool.decode([r["ids"]])[0])


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.materialize(stage(spark, kept, sf_dir), "test-stage")
            assert kept.columns == docs.columns
        got = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
        assert (not got) == docs.isEmpty()
