import hashlib
import random
import re
import time

from sitelens.llm import op05_simhash, op10_minhash
from sitelens.llm.common import staged
from sitelens.llm.components import components

from .conftest import WORD, lower


def sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, k):
    s, parent = sets(rows, k), {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


def test_near_duplicates(docs, rows):
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(docs, k).collect()}
        assert got == brute(rows, k)


def test_hot_group_of_near_copies(spark):
    """Copies at the edge of the threshold: only some of their pairs are links."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(90)] = f"e{rng.randrange(5)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(df, 4).collect()}
    assert got == brute(rows, 4)


def test_near_duplicate_cases(odd, empty):
    assert op10_minhash.near_duplicates(empty).count() == 0 and op10_minhash.one_of_each(empty).count() == 0
    got = op10_minhash.near_duplicates(odd).collect()
    assert len(got) == 7
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 1, True)] * 3 + [(2, 2, True), (3, 1, False)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_one_of_each_keeps_columns(docs, rows):
    kept = op10_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in brute(rows, 5).items() if i == c)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (50, 50), (60, 61), (60, 62), (60, 63), (99, 60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 60 for i in (60, 61, 62, 63, 99)}


def test_edited_texts(docs, rows):
    ordered = sorted(rows)
    got = {r.doc_id: r for r in op05_simhash.compare_edited(docs).collect()}
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint for r in got.values()}
    for n, (i, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)]
        q = len(text) // 4
        edited = text[:len(text) - q] + (after[1] or "")[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, likeness in ((r.edited_fingerprint, r.near_edited), (prints[after[0]], r.near_next)):
            assert abs(1 - bin(int(r.fingerprint, 16) ^ int(other, 16)).count("1") / 256 - likeness) < 1e-9
    by_text = {}
    for i, t, *_ in rows:
        assert by_text.setdefault(t or "", prints[i]) == prints[i]


def test_edited_cases(odd, empty, spark):
    assert op05_simhash.compare_edited(empty).count() == 0
    assert op05_simhash.compare_edited(odd).count() == 5  # rows without id have no place in the order
    one = op05_simhash.compare_edited(odd.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_within_the_radius(spark):
    """Every pair within the radius and no other, against brute force."""
    rng = random.Random(2)
    prints = [rng.getrandbits(256) for _ in range(12)]
    for _ in range(150):
        x = rng.choice(prints)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(256)
        prints.append(x)

    def parts(x):
        return [(v := x >> 64 * i & (1 << 64) - 1) - (v >> 63 << 64) for i in range(4)]

    df = spark.createDataFrame([(i, *parts(x)) for i, x in enumerate(prints)], ["doc_id", *op05_simhash.PARTS])
    queries = df.where("doc_id % 20 = 0")
    got = {(tuple(r[:4]), tuple(r[4:8]), r[8]) for r in op05_simhash.near_fingerprints(df, queries, 3).collect()}
    want = {(tuple(parts(a)), tuple(parts(b)), bin(a ^ b).count("1")) for a in prints[::20] for b in prints if bin(a ^ b).count("1") <= 3}
    assert got == want and len(want) > 20


def test_keys_of_queries_are_not_broadcast(spark):
    """800 fingerprints are few bytes, their keys 91 times as many: only estimates take these for small."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, *(rng.getrandbits(63) for _ in range(4))) for i in range(800)], ["doc_id", *op05_simhash.PARTS])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        found = op05_simhash.near_fingerprints(df, df)
        assert len(found.collect()) == 800
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plan = plan.split("Initial Plan")[0]
    assert re.search(r"SortMergeJoin.* \[key#\d+\], \[near_key#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[key#", plan)


def test_shuffle_files_of_a_staged_table_go(spark):
    def held():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString()))

    rows = spark.range(1000).repartition(3, "id")
    before = held()
    staged(rows)
    assert held() - before
    before = held()
    staged(rows, clean=True)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before


def test_search_covers_every_document(docs, spark):
    """The registered columns, against brute force over all fingerprints."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(300)]
        if i % 3:  # a near copy of the row before
            text = rows[-1][1].split(" ")
            text[rng.randrange(300)] = "edited"
        rows.append((10 * i, " ".join(text), "en", "s", 1))
    rows.append((7, rows[0][1], "en", "s", 1))
    got = {r.doc_id: r for r in op05_simhash.compare_and_search(spark.createDataFrame(rows, docs.schema[:5])).collect()}
    assert len(got) == len(rows)
    found = 0
    for i, r in got.items():
        near = [d for j, o in got.items() if j != i and (d := bin(int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).count("1")) <= 12]
        assert (r.n_near, r.nearest) == ((len(near), min(near, default=None)) if i % 20 == 0 else (None, None))
        found += len(near)
    assert found > 30


def test_terms_fade_with_the_number_of_words(spark):
    text = " ".join(f"w{i}" for i in range(63))
    a, b = op05_simhash.fingerprints(*op05_simhash.utf8(op05_simhash.pa.array([text, text + " more"])))
    assert bin(int.from_bytes(a.tobytes()) ^ int.from_bytes(b.tobytes())).count("1") < 40
