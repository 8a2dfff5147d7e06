import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kerbgraph.llm import divergence, fingerprint, html_text, merkle, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Wörter €😀 und mehr. " * 300


def poly(text):
    value, power = 0, 1
    for c in text:
        value, power = (value + (ord(c) + 1) * power) % fingerprint.P, power * fingerprint.BASE % fingerprint.P
    return value


def some_text(rng, n):
    return "".join(rng.choice("abcdefgh ij\n") for _ in range(n))


def test_arithmetic():
    rng = random.Random(3)
    pairs = [(rng.randrange(fingerprint.P), rng.randrange(fingerprint.P)) for _ in range(500)] + [(fingerprint.P - 1, fingerprint.P - 1), (0, 5)]
    a, b = (np.array([p[i] for p in pairs], np.uint64) for i in (0, 1))
    assert fingerprint.times(a, b).tolist() == [x * y % fingerprint.P for x, y in pairs]
    assert fingerprint.minus(a, b).tolist() == [(x - y) % fingerprint.P for x, y in pairs]
    e = np.array([0, 1, 5, 1 << 20, (1 << 31) + 7])
    up, down = fingerprint.powers()
    assert up(e).tolist() == [pow(fingerprint.BASE, int(x), fingerprint.P) for x in e]
    assert set(fingerprint.times(up(e), down(e)).tolist()) == {1}


def test_spans_and_extensions():
    rng = random.Random(4)
    a = some_text(rng, 900)
    b = some_text(rng, 100) + a[200:700] + some_text(rng, 50)
    x, y = fingerprint.Prefixes(fingerprint.codes_of(a)), fingerprint.Prefixes(fingerprint.codes_of(b))
    i, j = np.array([0, 200, 300, 690, 899]), np.array([0, 100, 200, 590, 649])

    def plain(p, q):
        n = 0
        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
            n += 1
        return n

    assert x.extension(i, y, j).tolist() == [plain(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
    assert x.span(np.array([200]), np.array([500]))[0] == y.span(np.array([100]), np.array([400]))[0] != x.span(np.array([200]), np.array([501]))[0]


def test_cuts_hold_prefix_hashes_and_long_texts_agree():
    rng = random.Random(5)
    texts = ["", "a", "aa" * 400, some_text(rng, 5000), LONG]
    cuts = fingerprint.Cuts(texts)
    for r, t in enumerate(texts):
        assert int(cuts.total[r]) == poly(t) and cuts.first[r + 1] - cuts.first[r] <= fingerprint.CUTS
        assert all(int(cuts.value[x]) == poly(t[: cuts.pos[x]]) for x in range(cuts.first[r], cuts.first[r + 1]))
    assert fingerprint.Cuts.parse(cuts.strings()).strings() == cuts.strings()
    # a text hashed stretch by stretch has the cuts that it has in one piece
    once = fingerprint.Cuts([texts[3]])
    row, pos, level, value = once._long(0, texts[3])
    assert pos.tolist() == cuts.pos[cuts.first[3] : cuts.first[4]].tolist() and value.tolist() == cuts.value[cuts.first[3] : cuts.first[4]].tolist()


def test_stretches(monkeypatch):
    rng = random.Random(6)
    text = some_text(rng, 7000)
    whole = fingerprint.Cuts([text]).strings()
    monkeypatch.setattr(fingerprint, "STRETCH", 512)
    monkeypatch.setattr(fingerprint, "_tables", [])
    monkeypatch.setattr(fingerprint, "_context", [])
    assert fingerprint.Cuts([text, text[:100]]).strings()[:1] == whole


def test_likeness():
    rng = random.Random(7)
    a = some_text(rng, 4000)
    texts = [a, a[:2000] + some_text(rng, 2000), some_text(rng, 4000), a[:1000] + "!" + a[1000:3000] + "??" + a[3000:], a + some_text(rng, 4000), ""]
    cuts = fingerprint.Cuts(texts)
    got = fingerprint.likeness(cuts, np.zeros(6, np.int64), cuts, np.arange(6))
    assert got[0] == 1 and 0.44 < got[1] < 0.54 and got[2] < 0.05 and got[3] > 0.85 and 0.58 < got[4] < 0.7 and got[5] == 0
    assert fingerprint.likeness(cuts, np.arange(6), cuts, np.zeros(6, np.int64)).tolist() == got.tolist()
    assert fingerprint.likeness(cuts, np.array([5]), cuts, np.array([5]))[0] == 1


def odd_documents():
    rng = random.Random(8)
    rows = [(i, some_text(rng, rng.choice([0, 1, 2, 7, 40, 300])), rng.choice(["en", "de", None]), rng.choice(["a", "b", None, ""]), i) for i in range(60)]
    rows += [(5, "again", "en", "a", None), (5, "again", "en", "a", None), (None, None, None, None, None), (None, "x\ny", "en", "a", 3), (70, LONG, "de", "ß", -1), (71, LONG, "de", "ß", 2), (72, "Straße STRASSE", "de", "ß", 2)]
    return rows + [(80, "hot one\n", "en", "hot", 1)] * 30 + [(200 + i, f"hot {i} words words", "en", "hot", 1) for i in range(30)]


@pytest.mark.parametrize("range_bytes", [fingerprint.RANGE_BYTES, 400])
def test_fingerprint_documents(spark, range_bytes):
    rows = odd_documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", range string, tail int")
    out = fingerprint.fingerprint_documents(df, range_bytes).collect()
    assert len(out) == len(rows)
    plain = [(i, t or "") for i, t, *_ in rows]
    # the order, with rows of one doc_id by hash: told from what Spark hashes
    ties = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t for _, t in plain}], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)
    expected = Counter()
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[: min(half, len(following))]
        expected[i, len(text), hashlib.sha256(changed.encode()).hexdigest(), *fingerprint.Cuts([text, changed]).strings()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in out) == expected
    assert all(0 <= r[c] <= 1 for r in out for c in ("near_edited", "near_next"))
    assert sum(r["near_next"] == 1 for r in out if r["doc_id"] == 80) >= 29
    assert fingerprint.fingerprint_documents(df.limit(0)).count() == 0
    lone = fingerprint.fingerprint_documents(df.where("doc_id = 70")).first()
    assert lone["near_next"] == 1 and lone["edited_sha256"] == hashlib.sha256((LONG[: len(LONG) // 2] * 2).encode()).hexdigest()


def test_common_prefix(spark):
    df = spark.createDataFrame([("abc", "abd"), (None, "x"), (LONG, LONG + "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(fingerprint.common_prefix("a", "b")).collect()] == [2, 0, len(LONG), 0]


def tree(nodes):
    """All levels of a tree of threes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([merkle.h(b"".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 9, 10, 26, 27, 28, 81, 100])
def test_traversal(n):
    leaves = [merkle.h(str(i).encode()) for i in range(n)]
    levels = tree(leaves)
    assert merkle.block_root(leaves, merkle.height(n)) == levels[-1][0]
    for i, path in enumerate(merkle.traverse(leaves, merkle.height(n))):
        at = i
        for (left, right), level in zip(path, levels, strict=False):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            assert (left, right) == (b"".join(run[: at % 3]), b"".join(run[at % 3 + 1 :]))
            at //= 3
        assert merkle.fold(leaves[i], path) == levels[-1][0] and len(path) == len(levels) - 1
    # a block that is part of a larger tree climbs all its levels, alone where it must
    top = leaves
    for _ in range(6):
        top = [merkle.h(b"".join(top[i : i + 3])) for i in range(0, len(top), 3)]
    if n <= 3**6:
        assert merkle.block_root(leaves, 6) == top[0] and all(merkle.fold(leaf, p) == top[0] for leaf, p in zip(leaves, merkle.traverse(leaves, 6), strict=True))


def plain_manifest(rows):
    def counted(v):
        v = None if v is None else str(v).encode()
        return b"-" if v is None else str(len(v)).encode() + b":" + v

    def leaf(i, text, lang, source, n):
        return merkle.h(b"".join(map(counted, (i, source, lang, n, text))))

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[2] for x in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = Counter()
    for k, name in enumerate(names):
        for i, (_, _, node, r) in enumerate(groups[name]):
            path = []
            for levels, at in ((trees[name], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    path.append((b"".join(run[: at % 3]), b"".join(run[at % 3 + 1 :])))
                    at //= 3
            cut = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = merkle.fold(leaf(r[0], r[1].replace("\n", ""), *r[2:]) if cut else node, path)
            out[r[0], name, node.decode(), trees[name][-1][0].decode(), top[-1][0].decode(), merkle.h(b"".join(x for p in path for x in p)).decode(), folded.decode(), folded == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    """With blocks of 3 and 9 leaves, trees reach over several rounds of blocks."""
    rows = odd_documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", tree string, idx int")
    out = merkle.manifest(df, levels)
    columns = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = Counter(tuple(r[c] for c in columns) for r in out.collect())
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_small(spark):
    df = spark.createDataFrame(odd_documents(), DOCS)
    assert merkle.manifest(df.limit(0)).count() == 0
    lone = merkle.manifest(df.where("doc_id = 70")).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def plain_audit(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for _, text, lang, source, _ in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = [t for t, n in seen.items() if n >= divergence.LEAST_DOCUMENTS]
        sources = sorted({s for g, s, _ in docs if g == lang})
        count = {s: Counter(t for g, x, w in docs if g == lang and x == s for t in w) for s in sources}
        every = sum(count.values(), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(count[s]) for s in sources}, shares(every)
        for s in sources:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, divergence.TERMS)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item, value, rank] += 1
    return out


@pytest.mark.parametrize(("bucket", "tile"), [(divergence.CELLS, divergence.TILE), (20, 2)])
def test_audit(spark, bucket, tile):
    rng = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["ÄÖ", "Straße", "ABC", "abc", "x1y", "😀"]
    rows = odd_documents() + [(900 + i, " ".join(rng.choices(words, k=rng.choice([0, 3, 30]))), rng.choice(["en", "fr"]), f"s{rng.randrange(7)}", 1) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", term string, n int")
    out = divergence.audit(df, bucket, tile)
    assert Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out.collect()) == plain_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_ranks_of_terms_are_cut_with_ties(spark):
    """Each source has 300 terms above its language's share, all of equal value."""
    rows = [(i, " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}{'xy'[i % 2]}" for j in range(300)), "en", f"s{i % 2}", 1) for i in range(12)]
    out = divergence.audit(spark.createDataFrame(rows, DOCS), 10, 1)
    assert Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out.collect()) == plain_audit(rows)


def test_slices_and_collisions():
    texts = ["Ab cd", "", None, "zz", "zzé-Ab", "1a"]
    data, start, end, row = divergence.slices(pa.array(texts, pa.string()))
    assert [(r, data[a:b].decode()) for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)] == [(0, "ab"), (0, "cd"), (3, "zz"), (4, "zzé"), (4, "ab"), (5, "a")]
    terms, code = divergence.grouped(data, start, end)
    assert [terms[c] for c in code] == ["ab", "cd", "zz", "zzé", "ab", "a"]
    # all slices share a hash: bytes tell them apart
    terms, code = divergence.verified(data, start, end, np.zeros(len(start), np.uint64))
    assert [terms[c] for c in code] == ["ab", "cd", "zz", "zzé", "ab", "a"] and len(set(terms)) == 5
    assert xxhash.xxh3_64_intdigest(b"ab") == xxhash.xxh3_64_intdigest(data[start[0] : end[0]])


def test_shares_are_exact():
    rng = random.Random(10)
    pairs = [(rng.randrange(w), w) for w in (rng.randrange(1, 9 * 10**15) for _ in range(300))] + [(0, 1), (4, 5)]
    n, whole = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    assert divergence.share(n, whole).tolist() == [1 + 10**9 * (x + 1) // w for x, w in pairs]


def plain_densities(page, chars, body, skip):
    """Each element's density and sum by a walk of its own over all elements."""
    n = len(page.tags)

    def up(i):
        while i >= 0:
            yield i
            i = page.parents[i]

    def count(i, of):
        return sum(of(j) for j in range(n) if i in set(up(j)) and not any(skip[k] for k in up(j)))

    linked = [any(page.tags[k] == "a" for k in up(j)) for j in range(n)]
    every, links = count(body, lambda j: chars[j]), count(body, lambda j: chars[j] * linked[j])
    out = []
    for i in range(n):
        c, lc, t, lt = (count(i, f) for f in (lambda j: chars[j], lambda j: chars[j] * linked[j], lambda j: 1, lambda j: int(page.tags[j] == "a")))
        t, lt = max(t - 1, 1), max(lt - (page.tags[i] == "a"), 1)
        base = 1 + math.log(math.log(c / max(c - lc, 1) * lc + links / max(every, 1) * c + math.e))
        out.append(c / t * max(math.log(c / max(lc, 1) * t / lt), 0) / base if c and not skip[i] else 0.0)
    blocks = [next((k for k in up(page.parents[i]) if page.tags[k] not in html_text.INLINE), None) for i in range(n)]
    return out, [sum(out[j] for j in range(n) if j and blocks[j] == i and page.tags[j] not in html_text.INLINE) for i in range(n)]


def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def article_of(html):
    inner = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", html[html.index("<article>") + 9 : html.index("</article>")]).replace("<b>", "")
    return " ".join(html_text.unescape(inner).split())


def test_html_densities_by_walks(spark):
    odd = ["", "<p>a", "<body><div><p>one <a href=x>two</a><div hidden>no</div><ul><li>x<li><a>y</a></ul></div><nav><a>z</a></nav>", "<b>a<p>b</p></b>", "<div>" * 20 + "deep"]
    for html in odd + pages(spark):
        page = html_text.parse(html)
        chars = [0] * len(page.tags)
        for node, text in page.events:
            chars[node] += len("".join((text or "").split()))
        body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
        skip = html_text.unseen(page)
        density, total, *_ = html_text.densities(page, chars, body, skip)
        want, sums = plain_densities(page, chars, body, skip)
        assert density == pytest.approx(want) and total == pytest.approx(sums)


def test_html_density_chooses_before_noise_lists(spark, monkeypatch):
    every = pages(spark)
    assert all(html_text.extract(x) == article_of(x) for x in every)
    monkeypatch.setattr(html_text, "noise", lambda page, *_: [False] * len(page.tags))
    right = sum(html_text.extract(x) == article_of(x) for x in every)
    assert right > 0.93 * len(every)  # density alone
    real = html_text.densities
    monkeypatch.setattr(html_text, "densities", lambda *a: ([1.0] * len(a[1]), [1.0] * len(a[1]), *real(*a)[2:]))
    assert sum(html_text.extract(x) == article_of(x) for x in every) < 0.1 * len(every)
    monkeypatch.setattr(html_text, "densities", real)
    monkeypatch.setattr(html_text, "choose", lambda page, body, skip, *_: [not s for s in skip])
    assert sum(html_text.extract(x) == article_of(x) for x in every) < 0.1 * len(every)


def test_html_article_within_a_form_and_long_comments():
    words = "Words of the article stand here. " * 8
    page = f"<body><form><div><h1>Head</h1><p>{words}</p><p>{words}</p><div class='comments'><p>Reader says</p></div></div></form><div id=comments>{'<p>I say this and that of it all, for long and long.</p>' * 9}</div></body>"
    assert html_text.extract(page) == " ".join(("Head " + words * 2).split())


def labelled(sf):
    import duckdb

    rows = duckdb.sql(f"select d.doc_id, text, max(toxic) from '{sf}/documents.parquet' d join '{sf}/labels.parquet' using (doc_id) where toxic is not null group by all order by doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    return [r for r, h in zip(rows, held, strict=True) if not h], [r for r, h in zip(rows, held, strict=True) if h]


@pytest.mark.parametrize(("sf", "recall", "precision"), [("/root/testdata/sf0.01", 0.5, 0.7), ("/root/testdata/sf0.1", 0.8, 0.75)])
def test_toxicity_on_held_out_rows(sf, recall, precision):
    """37 and 329 toxic rows to learn from; about a quarter of the toxic rows hold nothing that others hold."""
    rows, held = labelled(sf)
    toxic = [r for r in rows if r[2]]
    clean = [r for r in rows if not r[2]][: toxicity.SAMPLE_ROWS]
    sample = sorted(toxic + clean)
    net = toxicity.train([r[1] for r in sample], np.array([r[2] for r in sample]), len(toxic) / len(rows))
    flagged = toxicity.score_texts(net, pa.array([r[1] for r in held], pa.string())) >= toxicity.THRESHOLD
    hits = sum(f and r[2] for f, r in zip(flagged.tolist(), held, strict=True))
    assert hits >= recall * sum(r[2] for r in held) and hits >= precision * flagged.sum()


def test_toxicity_learns_from_words_wherever_they_stand():
    """In texts of some thousand words, the mark may lie anywhere."""
    rng = random.Random(12)
    plain = [f"w{i}" for i in range(40)]

    def text(mark):
        words = rng.choices(plain, k=3000)
        words[rng.randrange(3000)] = mark
        return " ".join(words)

    texts, labels = [text("vile") for _ in range(40)] + [text("kind") for _ in range(120)], np.array([1] * 40 + [0] * 120)
    net = toxicity.train(texts, labels, 0.2)
    scores = toxicity.score_texts(net, pa.array([text("vile") for _ in range(6)] + [text("kind") for _ in range(6)]))
    assert scores[:6].min() > 0.9 and scores[6:].max() < 0.1
