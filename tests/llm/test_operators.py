"""The operators on small frames: plain versions, nulls, empty and long texts, ties, repeated rows, odd columns."""

import collections
import glob
import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyframe.llm import (_linking, decontam, editprint, hmm, linededup, mixing, neardup, oracles, passages, queries,
                            tokencount, toxicity, urlfilter)
from storyframe.llm import _text as T
from storyframe.session import shared_dir
from tests import oracle
from tests.conftest import SF_DIR

SCHEMA = "doc_id long, text string, source string, keep string, node long, row string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(3000))
BASE = " ".join(f"b{i}" for i in range(60))
LINE = "A line that is long enough to be dropped, 123"
ROWS = [
    (1, BASE, "s"), (2, BASE.replace("b59", "other"), "s"), (2, BASE.replace("b59", "other"), "s"), (3, None, "s"),
    (4, "", None), (None, BASE + "!", None), (None, None, "t"), (5, LONG, "t"), (6, LONG, "t"), (7, "one two", "u"),
    (8, "one\ntwo", "u"), (9, "x" * 20000, "v"),
    *[(10 + i, f"{LINE}\n own {i}\n {LINE.upper()}\t", "t") for i in range(6)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "k", 1, "r", len(t or "")) for i, t, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    got = oracle.actual(queries.REGISTRY[name](spark, SF_DIR))
    assert got == oracle.expected(oracle.connect(SF_DIR), oracles.ORACLES[name])


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.REGISTRY} == set(range(1, 14))


def test_urls(spark):
    urls = [None, "", "nothing", "HTTP://EN.Example.COM/en/7x?q#f", "a://com", "a://x.net/de/8#/", "b://net/de/?", "a://b://c"]
    pages = spark.createDataFrame([(u, "mine", "mine") for u in urls], "url string, host string, row string")
    got = {r.url: r for r in urlfilter.filter_urls(pages, queries.URL_RULES).collect()}
    assert (got["HTTP://EN.Example.COM/en/7x?q#f"].rule, got["HTTP://EN.Example.COM/en/7x?q#f"].host) == (
        "example.com/en/7", "en.example.com")
    assert got["b://net/de/?"].verdict == "block" and got["b://net/de/?"].row == "mine"
    assert (got[None].host, got[None].path, got[None].rule, got[None].verdict) == ("", "", None, "allow")
    assert (got["a://b://c"].host, got["a://b://c"].path) == ("b:", "//c")


def test_urls_follow_the_rules_of_the_contract(spark):
    verdicts = {"a://x.com/en/1": "block", "a://www.example.com/en/7": "allow", "a://x.net/de/8": "allow",
                "a://example.net/de/7": "allow", "a://www.example.net/de/81": "block", "a://x.org/es/": "block"}
    pages = spark.createDataFrame([(u,) for u in verdicts], "url string")
    assert {r.url: r.verdict for r in urlfilter.filter_urls(pages, queries.URL_RULES).collect()} == verdicts


def near_classes(rows, least=0.8):
    bags = [collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else
            collections.Counter() for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if (rows[a][1] or "") == (rows[b][1] or "") or (either and both / either >= least):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = collections.defaultdict(list)
    for i in range(len(rows)):
        ids[root(i)].append(rows[i][0])
    return sorted(((rows[i][0] is None, rows[i][0] or 0), min((x for x in ids[root(i)] if x is not None), default=None))
                  for i in range(len(rows)))


def test_near_duplicates(docs, empty):
    got = neardup.near_duplicates(docs)
    pairs = sorted(((r.doc_id is None, r.doc_id or 0), r.class_id) for r in got.collect())
    assert pairs == near_classes(ROWS)
    kept = neardup.kept(docs, got)
    assert kept.columns == docs.columns and kept.count() == len({r.class_id for r in got.collect()})
    assert neardup.near_duplicates(empty).count() == 0


def test_short_texts_are_near_duplicates_in_query_and_pipeline(spark, tmp_path):
    """Classes of equal and, at a lower likeness, of nearly equal light bags; texts without words stay apart."""
    rows = [(1, "Page not found"), (2, "page  NOT\nfound"), (3, "page not there"), (4, "a b c d e f g"), (5, "A b c d e f\tg"),
            (6, "a b c d e f"), (7, ""), (8, " "), (9, None), (10, "x"), (11, "X ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in queries.REGISTRY["op3_near_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 7, 10: 10, 11: 10}
    assert corpus_pipeline.drop_near_copies(spark, frame, "").count() == 7
    loose = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame, likeness=0.65).collect()}
    assert loose[6] == 4 and loose[3] == 3


def test_near_duplicates_in_blocks(spark):
    """A large group with chains: every block and the second pass are needed."""
    texts = []
    for i in range(40):
        base = [f"c{i // 20}_{k}" for k in range(80)]
        base[(i * 3) % 80] = f"edit{i}"
        texts.append(" ".join(base))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    sketches = frame.withColumn("node", F.xxhash64("text"))
    nodes = sketches.select("node", F.lit(1).cast("long").alias("weight"), F.array(F.lit(7).cast("long")).alias("keys"))
    classes = _linking.linked_classes(nodes, sketches.select("node", "text"), neardup.bag_like(5, 0.8), block_rows=6)
    named = sketches.join(classes, "node", "left").collect()
    groups = collections.defaultdict(set)
    for r in named:
        groups[r["class"]].add(r.doc_id)
    want = collections.defaultdict(set)
    for (_, i), c in near_classes(rows):
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r.node: r["class"] for r in _linking.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert _linking.components(links.limit(0)).count() == 0


def test_links_name_the_smallest_node_and_settled_links_need_no_round(spark, monkeypatch):
    """Stars around their smallest node are classes as they are: their links are written once and their classes once."""
    items = pa.table({"node": pa.array([9, 4, 6, 1], pa.int64()), "words": ["x", "x", "y", "x"]})
    same = lambda a, b: np.array([[x == y for y in b["words"].to_pylist()] for x in a["words"].to_pylist()])
    batches = list(_linking._links([items], None, same))
    assert [(r["a"], r["b"]) for b in batches for r in b.to_pylist()] == [(9, 1), (4, 1)]
    names, write = [], _linking.written
    monkeypatch.setattr(_linking, "written", lambda df, name: names.append(name) or write(df, name))
    links = spark.createDataFrame([(9, 1), (4, 1), (1, 4), (8, 2)], "a long, b long")
    assert {r.node: r["class"] for r in _linking.components(links).collect()} == {1: 1, 4: 1, 9: 1, 2: 2, 8: 2}
    assert names == ["edges", "least"]
    names.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "a long, b long")
    assert {r["class"] for r in _linking.components(chain).collect()} == {1}
    assert len(names) % 2 == 0 and len(names) <= 10


def test_components_of_mixed_graphs(spark):
    """Classes equal those of a plain union of sets, whichever way links point and whoever the hubs are."""
    draw = random.Random(5)
    pairs = [(1000, i) for i in range(900, 960)] + [(draw.randrange(1, 300), draw.randrange(1, 300)) for _ in range(220)]
    pairs += [(-5, i) for i in range(2000, 2060)] + [(2059, 3000), (3000, -9), (1000, 5000), (5000, 4999)]
    root = {x: x for pair in pairs for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r["class"] for r in _linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def test_lines(docs, empty):
    got = {r.doc_id: r for r in linededup.line_report(docs).where("doc_id >= 10").collect()}
    assert [got[i].n_dropped for i in range(10, 16)] == [2, 2, 2, 2, 2, 0]
    assert got[10].kept_sha256 == hashlib.sha256(b" own 0").hexdigest() and got[10].n_lines == 3
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert {r.text for r in out.where("doc_id IN (3, 10)").collect()} == {None, " own 0"}
    assert out.where("doc_id = 10").first().n_chars == 6
    assert linededup.line_report(empty).count() == 0


def test_lines_of_repeated_ids_count_once(spark):
    rows = [(1, LINE)] * 4 + [(2, LINE), (None, LINE), (3, LINE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.line_report(frame).agg(F.sum("n_dropped")).first()[0] == 0
    more = frame.union(spark.createDataFrame([(4, LINE)], "doc_id long, text string"))
    assert linededup.line_report(more).agg(F.sum("n_dropped")).first()[0] == 7


def test_bitmaps_round_trip():
    text = "a\nb\n\nc"
    assert linededup.kept_lines(text, None, 4) == text


def test_mix(docs, empty):
    rows = mixing.mix_report(docs, block_words=4, shard_blocks=16).collect()
    again = mixing.mix_report(docs.repartition(5), block_words=4, shard_blocks=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(ROWS)
    sizes = collections.Counter()
    for _, text, source in ROWS:
        sizes[source] += len(words(text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(names, itertools.cycle((1, 2, 3))))
    total, targets, free = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(targets.values())
        over = [s for s in free if weight[s] * rest / sum(weight[f] for f in free) > 3 * sizes[s]]
        if not over:
            targets |= {s: weight[s] * rest / sum(weight[f] for f in free) for s in free}
            break
        for s in over:
            targets[s] = 3 * sizes[s]
            free.discard(s)
    taken = collections.Counter()
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.1 * targets[s] + 8 for s in names)
    spans = mixing.mix_spans(docs, block_words=4, shard_blocks=16)
    assert spans.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_spans(empty).count() == 0


@pytest.mark.parametrize("stratum, bytes_", [(4096, 8 << 20), (2, 0)])
def test_mix_follows_its_draw(docs, sizes, monkeypatch, stratum, bytes_):
    """Shards are full, totals near the plan, and words taken are those of the blocks drawn; with strata and salts too."""
    monkeypatch.setattr(mixing, "SMALL_BYTES", bytes_)
    found = mixing.sized(docs)
    sources = mixing.targets(found)
    packed = [r for r in mixing.pack(found, sources).collect()]
    plan = {r.number: r for r in sources.collect()}
    drawn = mixing.slots(sources, 4, 16, 1, stratum=stratum).collect()
    blocks = {k: -(-r.source_size // 4) for k, r in plan.items()}
    wanted = {k: round(r.target * blocks[k] / r.source_size) if r.source_size else 0 for k, r in plan.items()}
    per_source, per_shard = (collections.Counter(r[c] for r in drawn) for c in ("number", "shard"))
    full = sum(wanted.values()) // 16
    short = [k for k in range(full) if per_shard[k] != 16]
    # places stay empty only where a source is used up
    assert sum(16 - per_shard[k] for k in short) <= full and max(per_shard.values()) <= 16
    for k, total in wanted.items():
        assert abs(per_source[k] - total) <= 3 * (full + 1) ** 0.5 + 1 and per_source[k] <= 3 * blocks[k]
        assert sorted(r.slot for r in drawn if r.number == k) == list(range(per_source[k]))
    times = collections.Counter((r.number, r.block) for r in drawn)
    for k in plan:
        each = [times[k, b] for b in range(blocks[k])]
        assert not each or max(each) - min(each) <= 1
    if stratum == 4096:
        want = sorted(sum(times[r.number, (r.begin + i) // 4] for i in range(r.size)) for r in packed)
        got = mixing.mix_report(docs, block_words=4, shard_blocks=16)
        assert sorted(r.taken for r in got.collect()) == want
        other = mixing.mix_report(docs, block_words=4, shard_blocks=7)
        assert sorted(r.taken for r in other.collect()) != want


def test_passages(spark, empty):
    passage = " ".join(f"p{i}" for i in range(55))
    own = lambda n, k: " ".join(f"o{n}_{i}" for i in range(k))
    rows = [(1, own(1, 100) + " " + passage + " " + own(2, 9)), (2, own(3, 7) + "\n" + passage.upper()),
            (3, own(4, 200)), (4, " ".join(passage.split()[:20]) + " " + own(5, 60)), (5, None), (6, ""), (None, passage)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep) for r in got} == {(1, True), (2, False)}
    assert all(100 <= r.first_word < 155 for r in got if r.doc_id == 1)
    assert passages.repeated_passages(empty).count() == 0


def test_passages_leave_no_tables_and_no_shuffle_files(spark):
    """What steps have written and shuffled goes when nothing reads it any more, not when the driver collects its garbage."""
    def tables():
        return {os.path.basename(p) for p in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*-*")}

    def shuffled():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        return {f for d in env.blockManager().diskBlockManager().localDirs() for f in glob.glob(f"{d}/*/shuffle_*.data")}

    text = " ".join(f"q{i}" for i in range(80))
    frame = spark.createDataFrame([(i, f"{text} {i}") for i in range(6)], "doc_id long, text string")
    before, files = tables(), shuffled()
    found = passages.repeated_passages(frame)
    for _ in range(50):
        if not shuffled() - files:
            break
        time.sleep(0.1)
    assert {name.split("-")[0] for name in tables() - before if name.count("-") == 1} == {"spans"}
    assert not shuffled() - files
    assert found.count() == 6


def test_keys_of_one_item_go_wherever_batches_end(spark):
    """Buckets of one to seven items, told apart in one pass over sorted rows, in batches of three."""
    rows = [(b * 10 + i, b * 7919) for b in range(40) for i in range(b % 8)]
    held = spark.createDataFrame(rows, "node long, bucket long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(tuple(r) for r in _linking.shared(held).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(r for r in rows if r[1] // 7919 % 8 > 1)


def test_items_of_repeated_documents_are_told_once():
    text = " ".join(f"w{i}" for i in range(30))
    found = T.words(pa.array([text]))
    node = T.signed(passages._items(found, np.array([2]), 24))[0]
    kind = pa.list_(pa.struct([("word", pa.int32()), ("node", pa.int64())]))
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([7] * n), pa.array([other, text][:n] if other else [text] * n), pa.array([[{"word": 2, "node": node}]] * n, kind)],
        ["doc_id", "text", "places"]) for n, other in ((2, "x"), (3, ""), (1, ""))]
    told = [b for b in passages._item_words(24)(iter(batches))]
    assert pa.Table.from_batches(told)["node"].to_pylist() == [node]
    ends = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    asked = [b.set_column(2, "places", pa.array([[{"begin": 2, "end": 26}]] * b.num_rows, ends)) for b in batches]
    assert pa.Table.from_batches([*passages._ends(5)(iter(asked))])["begin"].to_pylist() == [2]


def test_passages_are_whole(spark):
    """Spans against the longest common run of each pair of documents; a third document shares less than the second."""
    own = lambda n, k: [f"o{n}_{i}" for i in range(k)]
    texts, pairs = {}, []
    for n, size in enumerate((51, 52, 60, 75, 100, 150, 400) * 3):
        shared = [f"s{n}_{i}" for i in range(size)]
        texts[2 * n], texts[2 * n + 1] = own(2 * n, n * 7) + shared + own(2 * n + 1, 90), own(-n, 40 + n) + shared
        pairs.append((2 * n, 2 * n + 1))
    # words 0 to 79 stand in 100 and 101, all 140 in 101 and 102: document 101 keeps those it does not share with 100
    line = [f"t{i}" for i in range(140)]
    texts |= {100: own(100, 30) + line[:80] + own(101, 60), 101: own(102, 5) + line, 102: own(103, 9) + line}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in passages.repeated_passages(frame).collect():
        got[r.doc_id].append((r.first_word, r.n_words, r.keep))
    for a, b in pairs:
        place = {w: i for i, w in enumerate(texts[a])}
        same = [(place[w], j) for j, w in enumerate(texts[b]) if w in place]
        assert got[a] == [(same[0][0], len(same), True)] and got[b] == [(same[0][1], len(same), False)]
    assert got[100] == [(30, 80, True)] and got[102] == [(9, 140, False)]
    assert [x[:2] for x in got[101] if not x[2]] == [(5, 80)] and all(f + n == 145 for f, n, keep in got[101] if keep)


def test_leaks(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[5:30])), (2, None), (3, "tiny"), (None, "")],
                                  "item_id long, text string")
    got = decontam.find_passages(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in got) == [(0, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0)]
    blocks = decontam.find_passages(docs, bench, block_chars=20).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    rest = decontam.clean(docs, bench)
    assert rest.columns == docs.columns and rest.count() == len(ROWS) - 4
    assert decontam.find_passages(docs, bench.limit(0)).count() == 0 and decontam.clean(empty, bench).count() == 0


def test_leaks_are_found_up_to_the_edits_allowed(spark):
    draw = random.Random(8)
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").where("length(text) >= 24")
    items = {r.item_id: r.text for r in bench.collect()}
    rows = []
    for i, (item, text) in enumerate(sorted(items.items()) * 3):
        folded = list(re.sub(r"\s+", " ", text.lower()).strip())
        for _ in range(len(folded) // 5):
            at, kind = draw.randrange(len(folded)), draw.randrange(3)
            folded[at:at + (kind > 0)] = [] if kind == 1 else [draw.choice("abcdefghijklmnopqrstuvwxyz ")]
        rows.append((i, item, "some words before it " + "".join(folded) + " and some more behind"))
    frame = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_passages(frame, bench).collect()}
    assert sum((i, item) in found for i, item, _ in rows) >= 0.9 * len(rows)


def test_fingerprints(docs, empty, spark):
    got = editprint.neighbour_report(docs.repartition(3)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    want = sorted((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, *_), t, e in zip(order, texts, edited))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[5] == prints[6] and prints[3] == prints[4]
    assert editprint.neighbour_report(empty).count() == 0
    classes = {r.doc_id: r.class_id for r in editprint.similar_classes(docs.where("doc_id < 9")).collect()}
    assert classes[2] == 1 and classes[6] == 5 and classes[5] == 5


def test_toxicity(spark, empty):
    clean, bad = "a calm day. the sun is out", "a calm day! you awful thing\nthe sun"
    rows = [(i, bad if i % 3 == 0 else clean) for i in range(60)] + [(100, None), (None, bad), (101, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)] + [(1, 0), (2, None), (None, 1)],
                                   "doc_id long, toxic int")
    got = toxicity.report(frame, labels, toxicity.fold(F.col("doc_id"), 5) == 0)
    by = {r.doc_id: r for r in got.collect()}
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in by.values() if r.doc_id is not None and r.doc_id < 60)
    assert by[100].score == 0 and by[101].score == 0 and by[None].predicted == 1
    assert bad[by[0].worst_start:by[0].worst_end] == "you awful thing"
    model = toxicity.fit(frame, labels)
    spans = toxicity.offending_sentences(frame.where("doc_id = 0"), model).collect()
    assert [bad[s.start:s.end] for s in spans] == ["you awful thing"]
    kept = toxicity.drop_toxic(frame, labels, F.lit(False))
    assert kept.where("doc_id < 60").count() == 40
    assert toxicity.report(empty, labels, F.lit(False)).count() == 0
    assert toxicity.report(frame, labels.limit(0), F.lit(False)).where("score > 0.5").count() == 0


def test_toxicity_prior_does_not_depend_on_the_bound(spark):
    """The word is in half of 100 toxic and a tenth of 900 clean texts: 50 of the 140 that have it are toxic."""
    rows = [(i, "an odd thing" if (i % 2 if i < 100 else i % 10 == 0) else "a calm day") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(1000)], "doc_id long, toxic int")
    keyed = frame.where("doc_id IN (1, 2)").select(F.col("doc_id").alias("key"), "text")
    whole, drawn = ({r.key: r.score for r in toxicity.score(keyed, toxicity.fit(frame, labels, max_docs=n)).collect()}
                    for n in (1000, 100))
    assert whole[1] < 0.5 and drawn[1] < 0.5 and abs(whole[1] - drawn[1]) < 0.15 and drawn[2] < 0.2


def test_hmm(docs, empty):
    held = F.col("doc_id") % 2 == 0
    for options in ({}, {"classes": 8, "endings": 4, "table_words": 10}):
        got = hmm.report(docs, held, states=2, rounds=1, **options).collect()
        counts = collections.Counter()
        for i, text, _ in ROWS:
            if i is None or i % 2:
                counts.update([*words(text), None])
        total, distinct = sum(counts.values()), len(counts)
        import math
        want = sorted((len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]),
                       round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*words(t), None]), 6))
                      for _, t, _ in ROWS)
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert hmm.report(empty, held, states=2, rounds=1).count() == 0


def test_token_counts(docs, empty):
    vocabulary = tokencount.read_vocabulary()
    encoding, _ = tokencount.encoder(vocabulary)
    got = tokencount.line_tokens(docs.where("doc_id IS NOT NULL"), vocabulary)
    texts = dict((i, t or "") for i, t, _ in ROWS)
    for r in got.collect():
        assert r.n_tokens == len(encoding.encode_ordinary(texts[r.doc_id])) == sum(r.section_tokens)
        assert r.n_sections == texts[r.doc_id].count("\n") + 1 and r.n_chars == len(texts[r.doc_id])
    fields = tokencount.field_tokens(docs.where("doc_id IN (3, 7)"), ["text", "source"], vocabulary)
    assert {r.doc_id: len(r.section_tokens) for r in fields.collect()} == {3: 2, 7: 2}
    assert tokencount.line_tokens(empty, vocabulary).count() == 0


def test_pipeline_keeps_columns_and_grows_no_rows(spark):
    raw = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, before = raw, raw.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF_DIR).persist()
        assert docs.columns == raw.columns and docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR).count() == before
    assert raw.count() * 0.7 < before < raw.count()
