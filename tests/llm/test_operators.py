"""The training-data operators against brute force on small tables with hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import (
    decontam,
    html_extract,
    induced_sort,
    jaccard_join,
    line_dedup,
    packing,
    quality,
    queries,
    secret_scan,
    sharding,
    suffix_dedup,
    topk_search,
    wordhash,
)

R = random.Random(7)
WORDS = [a + b for a in ("th", "er", "on", "an", "Re", "in") for b in ("e", "ing", "tion", "é", "ou")]


def sentence(n):
    return " ".join(R.choice(WORDS) + ("." if R.random() < 0.1 else "") for _ in range(n))


BASE = [sentence(R.randrange(20, 120)) for _ in range(30)]
ITEM = " ".join(f"bench{i}" for i in range(30))


def _near(x):
    w = x.split()
    w[R.randrange(len(w))] = "changed"
    return " ".join(w)


TEXTS = [
    *BASE, *BASE[:5], *[_near(x) for x in BASE[5:12]], None, "", " ", "\n\n", "one", "two words", "é", "a\x00b c d e",
    BASE[0] + "\n" + BASE[1], "aaaa" * 120, "x" * 199, "x" * 200, "ab" * 150, sentence(3000),
    "intro " + ITEM + " outro", "few " + " ".join(ITEM.split()[:12]), " ".join(ITEM.split()[3:16]).upper(), "short item", "a short item here",
    "password = hunter2hunter TOKEN:abc toKen: 'abcdefg' AKIA" + "Z9" * 9 + " " + "0af" * 9, "naïve secret=éé api_key=\"k.e-y/1+2=\"",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that the operators use inside; two rows repeat, one has no id."""
    rows = [(i, x, "en", f"s{i % 12}", len(x or ""), i, "r", 1.0) for i, x in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, BASE[3], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, rid string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(10, ITEM), (9, "Short item"), (11, " ".join(ITEM.split()[:20])), (12, None), (13, "..."), (None, "two words")]
    return spark.createDataFrame(rows, "item_id long, text string")


def local(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_secret_scan(docs, empty):
    kinds = [
        ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    want = Counter()
    for i, x in local(docs):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in p.finditer(x) if len(m[g]) >= n)
        told = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        want[(i, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(told.encode()).hexdigest())] += 1
    out = secret_scan.report(docs)
    assert rows(out.drop("spans")) == want and out.filter("spans <> ''").count() >= 2
    assert secret_scan.report(empty).count() == 0


def test_added_secret_spans(spark):
    """All spans, those of the added rules too, as a plain scan of every rule finds them; matches of any length."""
    texts = [
        "x -----BEGIN " + "VERY LONG " * 5 + "PRIVATE KEY----- y", "ghp_" + "Ab1" * 200, "xoxb-" + "12-ab" * 100, "AIza" + "x" * 35, "eyJabcdefgh.abcdefghi.abcdefghij",
        "token=ghp_" + "z" * 40, "nothing", None, "gho_short",
    ]
    out = secret_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in out.collect()}
    for i, x in enumerate(texts):
        found = [(m.start(), k, m.end()) for k, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, x or "") if len(m[r.group]) >= r.least]
        assert got[i] == ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(found)), i
    assert all(got[i] for i in range(6)) and not any(got[i] for i in range(6, 9))


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") is None
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert secret_scan.trigram_query("abc|xyz") == ("or", "abc", "xyz")
    assert secret_scan.trigram_query("(?:abcd)?x") is None
    assert secret_scan.trigram_query("ab?cd[^x]*efg") == ("and", ("or", ("and", "abc", "bcd"), "acd"), "efg")


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href='x>y'>Home</a></nav>"
        '<div class="ad">Buy, now.</div><article><h1>Head &amp; line</h1><p>Some long  text,\n with &lt;marks&gt;. And more; yes.<p><b>Bold<br>next'
        '<p>Of.</p><aside>Related</aside><div class="cookie-notice">Cookies, ok.</div><!-- no --></article><section id="comments"><p>Nice, really.</p></section>'
        "<form>Name</form><footer>&copy; x</footer></body></html>"
    )
    assert html_extract.extract_text(page) == "Head & line\n\nSome long text, with <marks>. And more; yes.\n\nBold next\n\nOf."
    plain = "<div class=sidebar>a, b. c</div><div><h2>Title</h2><p>Long words here, and there. Many of them.</p><p>Again some, with marks; yes.</p></div>"
    assert html_extract.extract_text(plain) == "Title\n\nLong words here, and there. Many of them.\n\nAgain some, with marks; yes."
    for x in (None, "", "<", "<p", "<!-- x", "<script>x", "</p></b>", "<p a='x>y", "&am"):
        assert "<script" not in html_extract.extract_text(x)
    df = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    out = html_extract.report(df).collect()
    assert len(out) == 3 and {r.n_chars for r in out} == {0, len(html_extract.extract_text(page))}
    assert html_extract.report(df.limit(0)).count() == 0


def test_smallest_capacity():
    for _ in range(200):
        sizes = np.array([R.randrange(1, 20) for _ in range(R.randrange(1, 12))])
        k = R.randrange(1, 5)
        best = {0: 0}
        for _ in range(k):  # best[i]: least capacity of the first i sizes
            best = {j: min(max(best[i], int(sizes[i:j].sum())) for i in best if i <= j) for j in range(len(sizes) + 1)}
        assert sharding.smallest_capacity(sizes, k)[0] == best[len(sizes)]


def test_sharding(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "BIG", 8)
    out = sharding.report(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in local(docs))
    slots, of = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    groups = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).groupBy("h").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in groups)
    big = {r.h for r in groups if r.n > total // 8}
    order = sorted(groups, key=lambda r: (r.h >> 62, r.h in big, r.h))
    assert max(Counter({s: sum(r.size for r in out if r.shard == s) for s in slots}).values()) == sharding.smallest_capacity(np.array([r.n for r in order]), 8)[0]
    assert sharding.report(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.report(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False)) and own[0].offset == 0 and own[-1].offset + own[-1].length <= 1024
    got, want = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), Counter()
    for i, x in local(docs):
        ids = np.array([*tk.encode(x, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            n = first if k == 0 else 1024
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert got == want
    assert len(by) <= -(-sum(r.length for r in out) // 1024) + 2
    assert packing.report(empty).count() == 0


def test_encoder_with_added_tokens():
    from tokenizers import Tokenizer

    e, tk = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for x in ("", "  ", "a  b", "a<|endoftext|>b", "x\x1cy \x85z", "it's\n\n 12é "):
        assert e(x).tolist() == tk.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "a", "7", "-=", "é"])
def test_encoder_on_very_long_runs(run):
    """Runs of one kind of characters, of 2 MB and about the length where the library changes."""
    from tokenizers import Tokenizer

    e, tk = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for n in (packing._LONG_RUN - 1, packing._LONG_RUN, 2_000_000):
        x = f"some words {run * (n // len(run))} and more"
        assert e(x).tolist() == tk.encode(x, add_special_tokens=False).ids


def _plain_rule(lengths, capacity):
    """The placement rule by trying every open sequence."""
    used, out = [], []
    for s in lengths:
        gaps = Counter(capacity - u for u in used if 0 < capacity - u < capacity)
        best = None
        for b, u in enumerate(used):
            g = capacity - u
            if g >= s:
                after = gaps.copy()
                after[g] -= 1
                if g > s:
                    after[g - s] += 1
                cost = (sum(v * v for v in after.values()), g)
                if best is None or cost < best[0]:
                    best = (cost, g)
        out.append(None if best is None else best[1])
        if best is None:
            used.append(s)
        else:
            used[next(b for b, u in enumerate(used) if capacity - u == best[1])] += s
    return out


def test_sum_of_squares_rule():
    """The gap chosen for each piece is the one that trying all of them finds."""
    for k in range(60):
        lengths = sorted((R.randrange(1, 21) for _ in range(R.randrange(1, 60))), reverse=k % 2 == 0)
        _, offset = packing.sum_of_squares(np.array(lengths), 20)
        assert [None if o == 0 else 20 - o for o in offset.tolist()] == _plain_rule(lengths, 20)


def test_packing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOT", 16)
    data = [(1, "same words here")] * 300 + [(2, "word " * 3000)] * 3 + [(3, " " * 1_000_000), (None, None)]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
    assert Counter(r.doc_id for r in out)[1] == 300 and Counter(r.doc_id for r in out)[2] == 9 and sum(r.doc_id is None for r in out) == 1


def test_sum_of_squares():
    number, offset = packing.sum_of_squares(np.array([6, 5, 5, 4, 10]), 10)
    assert number.tolist() == [0, 1, 1, 0, 2] and offset.tolist() == [0, 0, 5, 6, 0]


def test_topk(spark, monkeypatch):
    turns = [(i, i % 3, R.choice([sentence(R.randrange(1, 40)), sentence(3), None, "", BASE[0]])) for i in range(400)]
    df = spark.createDataFrame([*turns, turns[20]], "conv_id long, turn long, text string").repartition(3)
    words = [[w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w] for _, _, x in [*turns, turns[20]]]
    n, mean = len(words), sum(map(len, words)) / len(words)
    frequency = Counter(w for x in words for w in set(x))
    keys = [(a, b) for a, b, _ in [*turns, turns[20]]]
    want = Counter()
    for q, qk in zip(words, keys, strict=True):
        if qk[0] % 20 == 0:
            scored = []
            for x, k in zip(words, keys, strict=True):
                tf = Counter(x)
                s = sum(c * np.log1p((n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, c in Counter(q).items() if w in tf)
                if s:
                    scored.append((-round(s, 9), k))
            for rank, (s, k) in enumerate(sorted(scored)[:10], 1):
                want[(*qk, rank, *k, round(-s, 6))] += 1
    for rows_per_shard in (64, 32_768):
        monkeypatch.setattr(topk_search, "SHARD_ROWS", rows_per_shard)
        monkeypatch.setattr(topk_search, "BLOCK", 16)
        got = rows(topk_search.report(df))
        assert Counter({k[:5]: v for k, v in got.items()}) == Counter({k[:5]: v for k, v in want.items()})
        scores = {k[:5]: k[5] for k in want}
        assert all(abs(scores[k[:5]] - k[5]) < 2e-6 for k in got)
    assert topk_search.report(df.limit(0)).count() == 0


def test_topk_searches_documents(spark, tmp_path):
    """Documents are queries and hits; there is no other table here."""
    texts = [(20, "alpha beta gamma"), (21, "alpha beta delta"), (22, "omega"), (40, "omega " * 5000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_exact_topk_search(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r["rank"], r.hit_doc_id) for r in got} == {(20, 1, 20), (20, 2, 21), (40, 1, 40), (40, 2, 22)}


def test_topk_shuffles_nothing_per_shard(spark, monkeypatch):
    """25 shards instead of one: no query and no hit travels for each of them. Blocks of queries change nothing."""
    texts = [(i, " ".join(R.choice("abcdefghijklmnop") * R.randrange(1, 3) for _ in range(R.randrange(1, 30)))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).cache()

    def run(**limits):
        for k, v in limits.items():
            monkeypatch.setattr(topk_search, k, v, raising=False)
        sc = spark.sparkContext
        sc.setJobGroup(name := f"topk-{limits}", "")
        got = rows(topk_search.report_documents(df))
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return got, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    one, few = run(SHARD_ROWS=400), run(SHARD_ROWS=16)
    assert one[0] == few[0] and one[1] == few[1] > 0
    assert run(QUERY_TERMS=50)[0] == run(SHARD_TERMS=100)[0] == one[0]


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(docs, empty, benchmark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ROWS", block)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(low))
    items = [("" if r.item_id is None else str(r.item_id), words(r.text)) for r in benchmark.collect()]
    want = Counter()
    for i, x in local(docs):
        w, hit, found = words(x), set(), set()
        for item, iw in items:
            n = min(13, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    assert rows(decontam.report(docs, benchmark)) == want
    assert decontam.report(empty, benchmark).count() == 0
    assert decontam.report(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [2_000_000, 150])
def test_jaccard(docs, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got, sets = rows(jaccard_join.report(docs)), []
    for i, x in local(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", x.translate(low))
        sets.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    assert got == Counter((i, len(s), min(least[find(k)], default=None)) for k, (i, s) in enumerate(sets))
    assert jaccard_join.report(empty).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_jaccard_bridges_and_repeated_ids(spark, block, monkeypatch):
    """A row without an id is the only link between two others; one id on very many texts is that of documents of their own."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    w = [f"w{i}" for i in range(400)]
    chain = [" ".join(w[a : a + 100]) for a in (0, 6, 12)]  # neighbours share 91 of 103 shingles, the ends 85 of 109
    other = [" ".join(w[200 + a : 300 + a]) for a in (0, 6)]
    data = [(1, chain[0]), (None, chain[1]), (2, chain[2]), (7, other[0]), (7, other[1]), (None, "alone without id")] + [(9, f"text {i} of one id {i}") for i in range(60)]
    for order in (1, -1):
        out = jaccard_join.report(spark.createDataFrame(data[::order], "doc_id long, text string").repartition(3)).collect()
        by = sorted((r.doc_id or 0, r.component_id or 0) for r in out)
        assert by == [(0, 0), (0, 1), (1, 1), (2, 1), (7, 7), (7, 7)] + [(9, 9)] * 60


def test_jaccard_bands(spark, monkeypatch):
    """A cluster of rows of very different sizes, cut into bands and blocks, keeps all its links."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 40)
    texts = [" ".join(f"v{k}" for k in range(3 + int(1.09**i))) for i in range(70)]  # each a beginning of the next
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for percent in (80, 85, 100):
        got = {r.doc_id: r.component_id for r in jaccard_join.components(docs, 4, percent).collect()}
        size, want = [max(1, len(x.split()) - 3) for x in texts], {0: 0}
        for i in range(1, 70):  # a beginning of the next: the overlap is the smaller one
            want[i] = want[i - 1] if texts[i] == texts[i - 1] or (100 * size[i - 1] >= percent * size[i] and len(texts[i - 1].split()) > 3) else i
        assert got == want, percent


def test_link_block():
    for _ in range(60):
        base = [set(R.sample(range(60), R.randrange(1, 30))) for _ in range(4)]
        sets = [np.array(sorted(b ^ set(R.sample(range(60), R.randrange(3)))), np.uint64) for b in base for _ in range(4)]
        sets = [s for s in sets if len(s)]
        group = jaccard_join.link_block(sets, 85)
        parent = list(range(len(sets)))

        def find(k, parent=parent):
            while parent[k] != k:
                k = parent[k]
            return k

        for a in range(len(sets)):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(x & y) >= 85 * len(x | y):
                    parent[find(a)] = find(b)
        assert len({(group[k], find(k)) for k in range(len(sets))}) == len(set(group.tolist())) == len({find(k) for k in range(len(sets))})


def test_quality(spark, empty):
    good = [(i, sentence(40), 1) for i in range(300)]
    bad = [(i, " ".join(R.choice(WORDS).upper() + "!!" for _ in range(40)), 0) for i in range(300, 600)]
    df = spark.createDataFrame([(i, x, 0.5) for i, x, _ in good + bad] + [(600, None, 0.5), (601, "", None), (None, "the", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(5, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.report(df, labels).collect()}
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i in range(600) if out[i].held_out} == held and len(out) == 603
    assert sum(out[i].predicted == (i < 300) for i in held) >= 0.95 * len(held)
    assert out[600].score == out[601].score and all(0 <= r.score <= 1 for r in out.values())
    assert quality.report(empty.select("doc_id", "text"), labels).count() == 0
    assert {r.score for r in quality.report(df, labels.limit(0)).collect()} == {0.5}


def test_quality_conflicting_labels_and_long_texts(spark):
    """Equal rows with opposite labels train in one order however they are dealt; a text of 2 MB is one example."""
    data = [(i, f"word{i % 3} other words here", 0.1) for i in range(40)] + [(40, "long " * 400_000, 0.2)]
    labels = [(i, q) for i in range(41) for q in ((0, 1) if i % 2 else (i % 4 // 2,))]
    weights = []
    for parts in (1, 5):
        docs = spark.createDataFrame(data, "doc_id long, text string, x double").repartition(parts)
        weights.append(quality.fit(docs, spark.createDataFrame(labels[:: 1 if parts == 1 else -1], "doc_id long, quality int").repartition(parts)))
    assert (weights[0] == weights[1]).all() and weights[0].any()


def test_word_hashes():
    hasher = wordhash.WordHasher()
    texts = ["a b a", "", "  b\tlonger-word é ", None, "a"]
    import pyarrow as pa

    seen = {}
    for _, _, raw, ends in wordhash.text_blocks(pa.array(texts), 4):
        h, at = hasher(raw)
        row = np.searchsorted(ends, at)
        assert (np.diff(row) >= 0).all()
        for x, s in zip(h.tolist(), at.tolist(), strict=True):
            word = bytes(raw[s:]).split()[0]
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen) == 4


def _check_suffixes(body, limit):
    """All suffixes once, in descending order and with the true common prefixes, both up to DEPTH."""
    t = np.array([*body, 0], np.uint8)
    s, depth = bytes(t), induced_sort.DEPTH
    got = [(p, c) for a, b in induced_sort.sorted_suffixes(t, limit=limit) for p, c in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(p for p, _ in got) == list(range(len(s)))
    for (p, _), (q, c) in zip(got, got[1:], strict=False):
        n = 0
        while n < depth and p + n < len(s) and q + n < len(s) and s[p + n] == s[q + n]:
            n += 1
        assert min(c, depth) == n and (n == depth or s[p : p + depth] > s[q : q + depth])


def test_sorted_suffixes():
    for k in range(200):
        body = [R.randrange(1, 2 + k % 4) for _ in range(R.randrange(1, 90))]
        _check_suffixes(body[:8] * 9 if k % 5 == 0 else body, [1, 3, 10, 10**6][k % 4])


def test_suffixes_far_beyond_memory(monkeypatch):
    """Texts of sixty times the limit: names recur over levels, and no queue holds more tuples than the limit."""
    made, levels = [], []
    lanes, recursion = induced_sort.Lanes, induced_sort._order_by_recursion

    class Seen(lanes):
        def __init__(self, limit=1):
            super().__init__(limit)
            made.append((limit, self))

    monkeypatch.setattr(induced_sort, "Lanes", Seen)
    monkeypatch.setattr(induced_sort, "_order_by_recursion", lambda *a: levels.append(len(a[2])) or recursion(*a))
    for k in range(4):
        body = [R.randrange(1, 3 + k * 6) for _ in range(6000)]
        _check_suffixes(body[:700] * 3 + body[:3000] + [1] * 500 + body[3000:3400] if k % 2 else body, 100)
    assert len(levels) >= 8 and all(x.most <= 2 * limit for limit, x in made) and any(x._end for _, x in made)


def test_hot_anchors(spark, monkeypatch):
    """One passage in very many surroundings: its segments are dealt by further anchors, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 5)
    passage = sentence(60)
    docs = spark.createDataFrame([(i, f"{sentence(40)} {passage[: 150 + i % 90]} {sentence(40)}") for i in range(120)] + [(200, passage)], "doc_id long, text string")
    seen = []
    cut = suffix_dedup._cut
    monkeypatch.setattr(suffix_dedup, "_cut", lambda length, k, hot: seen.append(len(hot)) or cut(length, k, hot))
    got = rows(suffix_dedup.remove_repeats(docs, limit=1000))
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 10**9)
    assert got == rows(suffix_dedup.remove_repeats(docs)) == _without_repeats(docs, 200) and seen[0] > 0 and seen[1] == 0


def _without_repeats(docs, length):
    texts = [(i, x.encode()) for i, x in local(docs)]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    want = Counter()
    for i, b in texts:
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), sum(gone), sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize(("length", "k", "shard"), [(200, 80, 4 << 20), (30, 12, 50)])
def test_suffix_dedup(docs, empty, length, k, shard):
    assert rows(suffix_dedup.remove_repeats(docs, length, k, shard)) == _without_repeats(docs, length)
    assert suffix_dedup.report(empty).count() == 0
    assert suffix_dedup.remove_repeats(docs, with_text=True).filter("n_removed > 0 and kept is null").count() == 0


def test_line_dedup(spark, empty):
    notice, rare = "We use cookies.", "Seen on nine sites"
    data = [(i, f"own line {i}\n  {notice} \n" + (rare if i % 12 < 9 else f"other {i}"), f"s{i % 12}", 1, "x") for i in range(36)]
    data += [(50, None, "s0", 1, "x"), (51, "", "s1", 1, None), (52, "\n\n", None, 1, "x"), (53, notice, None, 1, "x"), (None, f"{notice}\nz", "s1", 1, "x"), data[0]]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_lines int, key string").repartition(3)
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "source", "key", "n_lines", "n_removed"]
    got = {(r.doc_id, r.text, r.n_removed) for r in out.collect()}
    places = [(i, p) for i, x, *_ in data if x for p, line in enumerate(x.split("\n")) if line.strip() == notice]
    first = min(places, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = set()
    for i, x, *_ in data:
        lines = None if x is None else x.split("\n")
        kept = [] if lines is None else [s for p, s in enumerate(lines) if s.strip() != notice or (i, p) == first]
        want.add((i, None if x is None else "\n".join(kept), 0 if lines is None else len(lines) - len(kept)))
    assert got == want and out.count() == len(data)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 4, 128])
def test_shard_search(block, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.zipf(1.3, 20) % 60).astype(np.int64) for _ in range(300)]
    counts = [rng.integers(1, 4, len(t)).astype(np.int32) for t in terms]
    length = np.array([int(c.sum()) for c in counts])
    if block == 4:
        monkeypatch.setattr(topk_search, "FREQUENT", 3)
    size = np.array([len(t) for t in terms])
    shard = topk_search.Shard(np.concatenate(terms), np.concatenate(counts), size, length, float(length.mean()), [np.arange(300)])
    asked, want = [], []
    for _ in range(60):
        q = np.unique(rng.zipf(1.3, 15) % 70).astype(np.int64)
        w = rng.random(len(q)) + 0.1
        scores = np.zeros(300)
        for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
            for x, y in zip(t, c, strict=True):
                if x in q:
                    scores[i] += w[q == x][0] * y * 2.2 / (y + 1.2 * (0.25 + 0.75 * length[i] / length.mean()))
        scores = np.round(scores, topk_search.DECIMALS)
        best = [i for i in np.lexsort((np.arange(300), -scores))[:10] if scores[i] > 0]
        asked.append((q, w))
        want.append((best, scores[best]))
    for (ids, got), (best, scores) in zip(shard.search(asked, 10), want, strict=True):
        assert ids.tolist() == best and np.allclose(got, scores)


def test_shard_search_scores_queries_together(monkeypatch):
    """Bounds and rarer terms took a pass per query and shard; now only the rows that can be among the best do."""
    rng = np.random.default_rng(5)
    terms = [np.unique(rng.zipf(1.3, 20) % 500).astype(np.int64) for _ in range(400)]
    size = np.array([len(t) for t in terms])
    shard = topk_search.Shard(np.concatenate(terms), np.ones(size.sum(), np.int32), size, size, float(size.mean()), [np.arange(400)])
    asked = [(t, np.ones(len(t))) for t in terms[:64]]
    alone = [shard.search([q], 10)[0] for q in asked]
    passes, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or count(*a, **k))
    together = shard.search(asked, 10)
    assert len(passes) <= 64 + 64 / topk_search.RARE_BATCH
    for (a, x), (b, y) in zip(alone, together, strict=True):
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()


def test_topk_scores_pairs_exactly_after_the_merge(monkeypatch):
    """Each task scored the best rows of each of its shards in double precision; only what is left of all tasks needs it, or too many equals."""
    rng = np.random.default_rng(11)
    terms = [np.unique(rng.integers(0, 500, 20)) for _ in range(400)]
    length = pa.array([len(t) for t in terms], pa.int32())
    columns = [pa.array(range(400)), pa.array(range(400)), pa.array(terms, pa.list_(pa.int64())), pa.array([np.ones(len(t), np.int32) for t in terms], pa.list_(pa.int32())), length]
    batch = pa.RecordBatch.from_arrays(columns, ["rid", "k0", "terms", "counts", "length"])
    first = np.concatenate([[0], np.cumsum([len(t) for t in terms[:40]])])
    asked = SimpleNamespace(value=(np.arange(40), first, np.concatenate(terms[:40]), np.ones(first[-1])))
    rounded, plain = [], np.round
    monkeypatch.setattr(np, "round", lambda *a, **k: rounded.append(1) or plain(*a, **k))
    found = pa.Table.from_batches(topk_search._search(10, 19.0, 1, asked, 50, 10**9)(iter([batch])))
    assert not rounded
    kept = Counter(found.column("query").to_pylist())
    assert all(10 <= kept[q] <= topk_search.MOST + 10 for q in range(40))


def test_topk_of_many_copies(spark, monkeypatch):
    """Rows that tie with more than a task keeps unscored: the first by their keys."""
    texts = [((i * 7) % 300, "alpha beta gamma" if i % 3 else f"alpha beta w{i % 9}") for i in range(300)]
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 40)
    got = topk_search.report_documents(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)).collect()
    of = dict(texts)
    want = {}
    for q in range(0, 300, 20):
        want[q] = sorted(i for i in of if of[i] == of[q])[:10]
    assert {q: [r.hit_doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.doc_id == q] for q in want} == want


def test_ties_of_suffixes_are_split_by_one_key(monkeypatch):
    """A sort by two keys took most of a shard's time; words too wide for one number with the rank are numbered first."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(np, "lexsort", None)
    for wide in (5, 1 << 62):
        rank = np.repeat([0, 4, 5, 9], [4, 1, 4, 3])
        word = rng.integers(0, wide, 12)
        word[[1, 6]] = word[[0, 5]]
        some = np.flatnonzero(rank != 4)
        want = rank.copy()
        for i in some.tolist():
            want[i] += sum(word[k] < word[i] for k in some.tolist() if rank[k] == rank[i])
        induced_sort._refine(rank, word[some], some)
        assert rank.tolist() == want.tolist()
