"""The pipeline's stages on a small corpus with planted cases, and its contract."""

import random

import corpus_pipeline
from quern.llm import simhash, similarity
from quern.llm.queries import ORACLE_SQL, QUERIES


def test_stages_drop_what_they_should_and_nothing_else(spark, tmp_path):
    rng = random.Random(6)

    def words(n):
        return " ".join(f"t{rng.randrange(5000)}" for _ in range(n))

    item = words(30)
    texts = {k: words(80) + (" vileword vileword " + words(10) if k % 5 == 0 else "") for k in range(600)}
    texts |= {1000 + k: texts[k] for k in range(1, 40)} | {2000: words(40) + " " + item + " " + words(40)}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, at = docs, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
        now = {r["doc_id"] for r in left.collect()}
        gone, at = at - now, now
        if name == "toxicity":
            wanted = {k for k, t in texts.items() if "vileword" in t}
            assert len(gone & wanted) >= 0.98 * len(wanted) and not gone - wanted
        elif name == "simhash_near_dedup":
            assert gone == {1000 + k for k in range(1, 40) if 1000 + k in at | gone and k in at} and not gone & at
        else:
            assert gone == {2000}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == at


def test_near_dedup_drops_edited_copies(spark):
    rng = random.Random(7)
    texts = {k: [f"t{rng.randrange(5000)}" for _ in range(200)] for k in range(60)}
    for k in range(40):
        # Each changed word breaks five shingles: 2 leave a similarity of some 0.9, 9 one below 0.8.
        copy = list(texts[k])
        for at in range(10, 10 + 20 * (2 if k < 20 else 9), 20):
            copy[at] = "edited"
        texts[1000 + k] = copy
    for k in range(150):
        texts[2000 + k] = [*texts[59][:60], f"own{k}", *texts[59][60:]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [(3000, None), (3001, " "), (3002, "One two"), (3003, "one  TWO")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(60), *range(1020, 1040), 3000, 3002}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_dedup_links_what_all_pairs_link(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: similarity.shingles((r["text"] or "").encode()) for r in docs.collect()}
    ids, root, near = sorted(rows), {k: k for k in rows}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = rows[a], rows[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and similarity.similarity(x, y) >= 0.8:
                near += len(x) != len(y) or (x != y).any()
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert near >= 10
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {k for k in ids if find(k) == k}


def test_shards_link_what_all_pairs_link():
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(150):  # a large group around one text, with up to ten words changed in a copy
        copy = list(base)
        for _ in range(rng.randrange(11)):
            copy[rng.randrange(60)] = f"own{k}x{rng.randrange(99)}" if k % 3 else f"few{rng.randrange(4)}"
        texts.append(" ".join(copy))
    sets = [similarity.shingles(t.encode()) for t in dict.fromkeys(texts)]
    got = similarity.shard_links(list(range(len(sets))), [similarity.fingerprint(s) for s in sets], [s.view("int64") for s in sets])
    assert all(similarity.similarity(sets[a], sets[b]) >= similarity.LEAST for a, b in got) and len(got) < len(sets)

    def components(pairs):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(k) for k in range(len(sets))]

    all_pairs = [(a, b) for a in range(len(sets)) for b in range(a) if similarity.similarity(sets[a], sets[b]) >= similarity.LEAST]
    assert components(got) == components(all_pairs) and len(set(components(got))) > 3


def test_large_shards_are_cut_without_loss(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + k, " ".join([*(f"w{n}" for n in range(80)), f"end{k}"])) for k in range(40)], "doc_id long, text string")
    both = docs.union(extra)
    whole = {r["doc_id"] for r in similarity.deduplicated(both).collect()}
    monkeypatch.setattr(similarity, "LIMIT", 300)
    assert {r["doc_id"] for r in similarity.deduplicated(both).collect()} == whole and sum(k >= 10_000 for k in whole) == 1


def test_shard_trees_are_sent_to_the_tasks_that_search_them(spark):
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(5, 65, 6)]
    sets = [similarity.shingles(t.encode()) for t in texts]
    prints = [similarity.fingerprint(s) for s in sets]
    rows = [(7, 0, j, k % 2, k, p - (1 << 64) if p >> 63 else p, t) for k, (p, t) in enumerate(zip(prints, texts, strict=True)) for j in (0, 1) if j or not k % 2]
    members = spark.createDataFrame(rows, "bucket long, i int, j int, own int, node long, fp long, text string")
    first = bytearray(simhash.tree_of(list(dict.fromkeys(prints[::2]))).packed())
    sent = spark.createDataFrame([(7, 0, j, first) for j in (0, 1)], "bucket long, i int, j int, tree binary")
    found = similarity.linked(members, sent, 3).collect()
    assert {x for pair in found for x in pair} == set(range(len(texts))) and any((a - b) % 2 for a, b in found)
    assert not any(a % 2 and b % 2 for a, b in found)  # the tree is that of the first part
    assert similarity.linked(members, sent.where("j = 0"), 3).where("a % 2 = 1 or b % 2 = 1").isEmpty()
    assert similarity.linked(members, sent.limit(0), 3).isEmpty()


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11)) and not ORACLE_SQL
    assert simhash.RADIUS == 2
