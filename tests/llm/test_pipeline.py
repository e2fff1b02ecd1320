"""The stages of the corpus pipeline: each against brute force on a small corpus, and all on the smallest tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from test_llm import buckets, llr_weights, prose, shingles, words

SF = "/root/testdata/sf0.001"
#: Columns that clash with what operators call theirs.
SCHEMA = "doc_id long, text string, lang string, source string, size int, score string, kept string, _time int, doc string, target double, taken long, n_words int, items string, _row string, own int"


def row(i, text, source="a"):
    return (i, text, "en", source, 7, "mine", "yes", 3, "d", 0.5, 11, -1, "none", "r", 9)


def corpus():
    rng = random.Random(8)
    item = prose(rng, 30, 5_000)
    texts = [prose(rng, rng.randrange(30, 90)) for _ in range(50)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60).split()) for _ in range(8)]
    near = [" ".join(t.split()[:-1] + ["other"]) for t in texts[:6]]
    dirty = [f"{prose(rng, 40)} {item} {prose(rng, 20)}", f"{prose(rng, 700)} {' '.join(item.split()[:14])}"]
    rows = [row(i, t, "abc"[i % 3] if i % 5 else None) for i, t in enumerate([*texts, *bad, *near, *dirty])]
    rows += [row(None, texts[2]), row(None, None), row(None, ""), row(70, None), row(71, " \n"), row(72, "few words"), row(73, prose(rng, 30_000, 9_000), "b")]
    rows += [row(3, texts[3]), row(3, texts[3]), row(4, prose(rng, 50)), row(None, texts[9] + " tail"), row(None, texts[9] + " tail"), row(80, "x " * 40, "wordless"), row(81, None, "void")]
    return rows, item


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, item = corpus()
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i < 50), int(i % 10 == 1)) for i in range(58)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "no id here")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return spark.createDataFrame(rows, SCHEMA), [tuple(r) for r in rows], sf


def result(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_stage(spark, case):
    docs, rows, sf = case
    trusted = {k for k, r in enumerate(rows) if r[0] is not None and r[0] < 50 and r[0] % 10 != 1}
    weights = llr_weights([r[1] for r in rows], trusted)
    want = Counter()
    for r in rows:
        w, b = words(r[1]), buckets(r[1])
        spans = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(spans)
        repeated = {k + j for k, s in enumerate(spans) if many[s] > 1 for j in range(8)}
        score = sum(weights[x] for x in b) / len(b) if b else 0.0
        want[r] += not (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and score >= -0.1
    assert result(P.quality(spark, docs, sf)) == +want
    assert 40 < want.total() < len(rows)


def test_near_duplicates_stage(spark, case):
    docs, rows, sf = case
    got = result(P.near_duplicates(spark, docs, sf))
    key = [("id", r[0]) if r[0] is not None else ("text", r[1] or "") for r in rows]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (key[i] == key[j] or (both and 100 * both >= 75 * len(sets[i] | sets[j]))) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    groups = defaultdict(list)
    for r, k in zip(rows, root, strict=True):
        groups[k].append(r)
    assert got.total() == len(groups)
    for members in groups.values():  # one of each group, of the smallest id; rows without an id come first
        first = min((-1 if r[0] is None else r[0]) for r in members)
        assert sum(got[r] for r in set(members)) == 1
        assert sum(got[r] for r in set(members) if (-1 if r[0] is None else r[0]) == first) == 1


def test_decontamination_stage(spark, case):
    docs, rows, sf = case
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode()) if w]
    item = cut(corpus()[1])
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    want = Counter()
    for r in rows:
        w = cut(r[1])
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(13)}
        want[r] += not (hit and 20 * len(hit) >= len(w))
    assert result(P.decontamination(spark, docs, sf)) == +want
    assert want.total() == len(rows) - 1


def test_mixing_stage(spark, case):
    docs, rows, sf = case
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(s for s in size if s is not None) + [None]
    weight = dict(zip(order, [3, 1, 2] * 3))
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        target |= {s: 2.0 * size[s] for s in over}
        free -= set(over)
        left -= sum(target[s] for s in over)
        if not free:
            break
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    queue, times = defaultdict(int), []
    said = lambda r: hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{len(words(r[1]))}".encode()).hexdigest()
    for r in sorted(rows, key=said):
        queue[r[3]] += (n := len(words(r[1])))
        times += [((queue[r[3]] + size[r[3]] * c) / target[r[3]], order.index(r[3]), n, r) for c in range(2) if n]
    want, words_taken = Counter(), 0
    for _, _, n, r in sorted(times, key=lambda x: x[:2]):
        words_taken += n
        if words_taken > sum(target.values()):
            break
        want[r] += 1
    assert result(P.mixing(spark, docs, sf)) == want
    empty = docs.where("text IS NULL OR trim(text) = ''")
    assert empty.count() > 0 and P.mixing(spark, empty, sf).count() == 0


def test_sharding_stage(spark, case):
    docs, rows, sf = case
    got = P.sharding(spark, docs, sf).collect()
    assert Counter(tuple(r)[:-2] for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_empty_tables_and_columns(spark, case):
    docs, _, sf = case
    for i, (_, stage) in enumerate(P.STAGES):
        none = stage(spark, docs.limit(0), sf)
        assert none.columns == [*docs.columns, *(["shard", "slot"] if i == 4 else [])] and none.count() == 0


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    base = P.shared_dir(spark)
    for i, (_, stage) in enumerate(P.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(f"{base}/test-stage-{i}")
        docs = spark.read.parquet(f"{base}/test-stage-{i}")
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        assert docs.columns == (columns if i < 4 else [*columns, "shard", "slot"])
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0
    per = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert len(per) == 8 and max(per) - min(per) <= 1
