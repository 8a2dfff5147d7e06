import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kerbgraph.llm import chat_format, license_rules, license_scan, sharding
from kerbgraph.llm.license_rules import BASE, rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sharding(spark):
    rows = [(i, f"text {i % 7}", None, None, None) for i in range(400)] + [(None, None, None, None, None), (5, "text 5", None, None, None), (6, "", None, None, None)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 403
    for shard in range(8):
        mine = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert mine == list(range(len(mine))) and 25 < len(mine) < 80
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] == 5}) == 1
    assert next(r["size"] for r in out if r["doc_id"] is None) == 1
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_weights(spark):
    df = spark.range(4000).select(sharding.shard_of(F.col("id").cast("string"), [1.0, 3.0, 0.0]).alias("s"))
    n = Counter(r["s"] for r in df.collect())
    assert n[2] == 0 and 2.6 < n[1] / n[0] < 3.4


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_license_base(spark):
    texts = [None, "", "...", "MIT License", "mit license mit-license MIT  LICENSE", "the GNU General Public License v2, or the Apache\nLicense, Version 2.0", "cc by cc-by-sa CC_BY 4.0", "mité license", "x mit licenses", "Licensed under the MIT license. " * 50, "apache licenſe", "kit License mit"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None)], DOCS)
    out = license_scan.scan(df).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


def sample_of(regex):
    """A text that a rule's regular expression matches: the first of alternatives, without what may be missing."""
    last = None
    while last != regex:
        last, regex = regex, re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)([?*]?)", lambda m: "" if m[2] else m[1], regex)
    out = regex.split("|")[0].replace("[cs]", "c").replace(".{1,60}?", "someone").replace(".{1,40}?", "someone").replace(".{1,30}?", "someone")
    return re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r".\?", "", out)).replace("  ", " ").strip()


def brute_scan(text):
    """Matches, kept ones, labels and score by Python's engine and the rule of suppression, written out."""
    words = " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER)))
    found = [(r, words[: m.start()].count(" "), words[: m.end()].count(" ")) for r in rules() if r.keyword in f" {words} " for m in re.finditer(rf"(?<![^ ])(?:{r.regex})(?![^ ])", words)]
    kept = []
    for r, a, z in found:
        before = lambda s, b, y: (b, -y, s.priority, s.rule) < (a, -z, r.priority, r.rule)
        if not any(s is not r and s.priority <= r.priority and b <= a and y >= z and before(s, b, y) for s, b, y in found):
            kept.append((r, a, z))
    labels = ",".join(sorted({r.label for r, _, _ in kept} | {r.label for r, _, _ in found if r.base}))
    strongest = min((r.priority for r, _, _ in [*kept, *[x for x in found if x[0].base]]), default=None)
    return {(r.rule, a, z) for r, a, z in found}, {(r.rule, a, z) for r, a, z in kept}, labels, 0.0 if strongest is None else 1.25 - 0.25 * strongest


def test_license_rules_and_suppression(spark):
    hand = {regex for part in (license_rules.NAMES, license_rules.TEXTS, license_rules.CLAUSES) for _, regex, *_ in part}
    assert len(hand) >= 200 and len(rules()) > 500
    rng = random.Random(4)
    samples = [sample_of(r.regex) for r in rules()]
    texts = ["Licensed under the Apache License, Version 2.0. This is GNU Lesser General Public License 2.1, SPDX-License-Identifier: BSD-3-Clause", None, "", "no license here at all"]
    texts += samples  # every rule's own words, and mixtures that overlap
    texts += [". ".join(rng.choice(samples) for _ in range(6)) + " licensed under mit license copyright 2020" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    hits = {}
    for h in license_scan.detect(df.withColumnRenamed("doc_id", "row"), "text", "row").collect():
        hits.setdefault(h["row"], []).append(h)
    scanned = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    silent = []
    for i, text in enumerate(texts):
        found, kept, labels, score = brute_scan(text)
        mine = hits.get(i, [])
        assert {(h["rule"], h["first"], h["last"]) for h in mine} == found, text
        assert {(h["rule"], h["first"], h["last"]) for h in mine if h["kept"]} == kept, text
        assert (scanned[i]["labels"], scanned[i]["score"]) == (labels, score), text
        if 4 <= i < 4 + len(samples) and i - 4 not in {r for r, _, _ in found}:
            silent.append((rules()[i - 4].regex, text))
    assert silent == []
    kept = {h["label"] for h in hits[0] if h["kept"]}
    assert {"apache-2.0", "lgpl-2.1", "bsd-3-clause"} <= kept and "unspecified" not in kept and "apache" not in kept


def test_license_tags(spark):
    """One real tag and one short form per license give its label, through the gate; a longer identifier isn't cut to a shorter one."""
    tags = [(label, f"SPDX-License-Identifier: {i}") for label, ids, _ in license_rules.TAGS for i in ids.split("/")]
    shorts = [("gpl-3.0", "GPLv3"), ("gpl-2.0", "GPL 2"), ("lgpl-2.1", "LGPLv2.1"), ("agpl-3.0", "AGPL-3.0"), ("mpl-2.0", "MPL 2.0"), ("apache-2.0", "Apache-2.0"), ("epl-2.0", "EPL-2.0"), ("wtfpl", "WTFPL")]
    asked = tags + shorts
    df = spark.createDataFrame([(i, text, None, None, None) for i, (_, text) in enumerate(asked)], DOCS)
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(df).collect()}
    assert {label for label, _, _ in license_rules.TAGS} == {label for label, _, _ in license_rules.NAMES}
    assert [(a, got[i]) for i, a in enumerate(asked) if a[0] not in got[i]] == []
    assert got[tags.index(("mit-0", "SPDX-License-Identifier: MIT-0"))] == ["mit-0"]


def test_roots_let_every_rule_through(spark):
    """A text made from a rule's own words holds one of its roots, which are parts of words."""
    for r in rules():
        sample = sample_of(r.regex)
        assert any(root in sample and " " not in root for root in license_scan.roots(r.keyword)), r


def test_chat_format(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "bad"), (2, 3, "user", None), (3, 0, "user", "alone"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("source", F.lit("x"))
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 9), (2, None, 3), (3, 1, 1)], "pair_id long, chosen_id long, rejected_id long")
    out = {r["pair_id"]: r for r in chat_format.format_pairs(df, pairs).collect()}
    r = out[0]
    assert r["prompt_turns"] == 2 and r["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert r["chosen"] == "<|assistant|>\ngood<|end|>\n" and [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"] if s["train"]] == ["good<|end|>\n"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["bad<|end|>\n", "<|user|>\n<|end|>\n"]
    assert out[1]["rejected"] == "" and out[1]["prompt"] == "" and out[2]["chosen"] == ""
    assert out[3]["prompt_turns"] == 3 and out[3]["chosen"] == out[3]["rejected"] == ""
    assert chat_format.query(df.limit(0)).count() == 0
