"""The pipeline against its stages done by brute force, and the registry."""

import collections

from test_operators import SCHEMA, corpus, shingles, words


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from stratalex.llm.sentencepiece_codec import Codec

    rows = corpus()
    clashing = SCHEMA + ", part string, place string, order int, rows int, before int, row int, ids string, _metadata string"
    spark.createDataFrame([(*r, "p", "q", 1, 2, 3, 4, "i", "m") for r in rows], clashing).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
        assert i == 4 or docs.columns == [c.split()[0] for c in clashing.split(", ")]

    def good(text):
        w = words(text)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in range(i, i + 3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    kept = [(r[0], r[1]) for r in rows if good(r[1])]
    assert collections.Counter((r.doc_id, r.text) for r in seen["quality_rules"]) == collections.Counter(kept)
    groups = {}
    for d, t in kept:
        bare = "".join(words(t))
        groups[bare] = min(groups.get(bare, (1, True, 0, "")), (-len(t), d is None, d or 0, t))
    single = [(None if missing else d, t) for _, missing, d, t in groups.values()]
    assert collections.Counter((r.doc_id, r.text) for r in seen["exact_dedup"]) == collections.Counter(single)
    gone, known = set(), sorted((d, shingles(t)) for d, t in single if d is not None)
    links = collections.defaultdict(set)
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if 100 * len(x & y) >= 75 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    for d, _ in known:
        reach, todo = {d}, [d]
        while todo:
            for o in links[todo.pop()] - reach:
                reach.add(o)
                todo.append(o)
        if min(reach) < d:
            gone.add(d)
    assert gone and sorted(r.doc_id for r in seen["ngram_jaccard_join"] if r.doc_id is not None) == [d for d, _ in known if d not in gone]
    mixed = collections.Counter(r.doc_id for r in seen["source_mixing"])
    assert set(mixed) <= {r.doc_id for r in seen["ngram_jaccard_join"]} and max(mixed.values()) <= 3
    codec, text = Codec.load(), {r.doc_id: r.text for r in seen["source_mixing"]}
    assert collections.Counter(r.doc_id for r in seen["sentencepiece"]) == mixed
    assert all(r.round_trip and list(r.ids) == list(codec.encode(text[r.doc_id])) for r in seen["sentencepiece"])
    first, again = ([(r.place, r.doc_id, len(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("place").collect()] for _ in range(2))
    assert first == again and [p for p, *_ in first] == list(range(len(seen["sentencepiece"])))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    from stratalex.llm.common import Workspace

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = len(Workspace.opened)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids", "round_trip", "place"]
    assert len(Workspace.opened) == before + 1  # those of the stages are deleted


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
