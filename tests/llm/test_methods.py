"""Methods of the scans against plain versions of them."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import licences, secrets, tiling

DOC = "doc_id long, text string"


def found_literals(text):
    return [text[a:b] for k, a, b in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize(("source", "found"), [
    ("DB_PWD=hunter2hunter2", ["hunter2hunter2"]),
    ("aws_secret_access_key = wJalrXUtnFEMI", ["wJalrXUtnFEMI"]),
    ("passphrase: q8w7e6r5t4", ["q8w7e6r5t4"]),
    ('client_secret = """Zx9Qw8Rt"""', ["Zx9Qw8Rt"]),
    ("client_secret = '''Zx9Qw8Rt'''", ["Zx9Qw8Rt"]),
    ('db_pwd =\n    "Zx9Qw8Rt"', ["Zx9Qw8Rt"]),
    ('db_pwd = \\\n  "Zx9Qw8Rt"', ["Zx9Qw8Rt"]),
    ('db_pwd = (\n  "Zx9Q"\n  "w8Rt"\n)', ["Zx9Q", "w8Rt"]),
    ("const dbPwd = `Zx9Qw8Rt`;", ["Zx9Qw8Rt"]),
    ("<password>Zx9Qw8Rt</password>", ["Zx9Qw8Rt"]),
    ('<add key="db_pwd" value="Zx9Qw8Rt"/>', ["Zx9Qw8Rt"]),
    ('auth: {key: "Zx9Qw8Rt"}', ["Zx9Qw8Rt"]),
    ("auth:\n  user: bobbybob\n  key: Zx9Qw8Rt\nother:\n  key: Zx9Qw8Rx\n", ["Zx9Qw8Rt"]),
    ('{"auth": {"user": "bobbybob", "key": "Zx9Qw8Rt"}, "x": {"key": "Zx9Qw8Ru"}}', ["Zx9Qw8Rt"]),
    ("[auth]\nkey = Zx9Qw8Rt\n[other]\nkey = Zx9Qw8Ru\n", ["Zx9Qw8Rt"]),
    ('k = "Zx9Q" + "w8Rt"; client_secret = k', ["Zx9Q", "w8Rt"]),
    ("db_pwd:\n  Zx9Qw8Rt\n", ["Zx9Qw8Rt"]),
    ("db_pwd: |\n  Zx9Qw8Rt\n", ["Zx9Qw8Rt"]),
    ("- name: DB_PWD\n  value: Zx9Qw8Rt\n", ["Zx9Qw8Rt"]),
    ('{"name": "DB_PWD", "value": "Zx9Qw8Rt"}', ["Zx9Qw8Rt"]),
    ('k = "Zx9Qw8Rt"\n# k = "other123"\ndb_pwd = k', ["Zx9Qw8Rt"]),
    ('k = "Zx9Qw8Rt" // k = "other123"\ndb_pwd = k', ["Zx9Qw8Rt"]),
    ('# db_pwd = "Zx9Qw8Rt"', ["Zx9Qw8Rt"]),
    ('Remember: the key of the house is under "the stone"', []),
    ("title:\n  Zx9Qw8Rt\n", []),
    ("<title>Zx9Qw8Rt</title>", []),
])
def test_syntax(source, found):
    assert found_literals(source) == found


@pytest.mark.parametrize("seed", range(5))
def test_random_programs(seed):
    """Programs of assignments, sums and comments, whose secrets a plain interpreter knows."""
    rng = random.Random(seed)
    for _ in range(200):
        names = ["alpha", "beta", "db_pwd", "clientSecret", "title", "authToken", "gamma"]
        lines, known, expected, at = [], {}, set(), 0
        for _ in range(rng.randint(1, 12)):
            name, comment = rng.choice(names), rng.random() < 0.15
            line = ("# " if comment else "") + rng.choice(("", "", "  ")) + name + rng.choice((" = ", "=", ": ", " := "))
            parts = []
            for i in range(rng.randint(1, 3)):
                line += rng.choice((" + ", "+")) if i else ""
                if rng.random() < 0.4 and (other := rng.choice(names)) in known:
                    line += other
                    parts += known[other]
                else:
                    value = "".join(rng.choice("abcdefghkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(rng.choice((3, 4, 9, 12))))
                    quote = rng.choice("\"'`")
                    parts.append((at + len(line) + 1, at + len(line) + 1 + len(value), value))
                    line += quote + value + quote
            parts = list(dict.fromkeys(parts))
            if not comment:
                known[name] = parts
            whole = "".join(p[2] for p in parts)
            # names' weights are over the threshold, so that entropy decides
            if name in ("db_pwd", "clientSecret", "authToken") and len(whole) >= 6 and secrets.sensitivity((name,)) * min(1.0, secrets.randomness(whole) / 2.5) >= 0.6:
                expected |= set([p[:2] for p in parts if p[1] - p[0] >= 6] or [p[:2] for p in parts])
            lines.append(line)
            at += len(line) + 1
        text = "\n".join(lines)
        base = [(a, b) for k, a, b in secrets.scan(text) if k != "literal"]
        expected = {(a, b) for a, b in expected if not any(x <= a and b <= y for x, y in base)}
        assert {(a, b) for k, a, b in secrets.scan(text) if k == "literal"} == expected, text


def deep(levels, opening, closing):
    return "".join(opening.format(i=i, pad=" " * (i % 400)) for i in range(levels)) + 'client_secret = "Zx9Qw8RtYu"\n' + closing * levels


@pytest.mark.parametrize(("opening", "closing"), [('n{i} = {{ "auth_token": "Zx9Qw8Rt{i}x",\n', "}"), ('"credentials": {{ "key{i}": "v", "password": "Zx9Qw8Rt{i}x",\n', "}"), ("{pad}level{i}:\n{pad} db_password: Zx9Qw8Rt{i}x\n", "")])
def test_time_grows_with_depth(opening, closing):
    """Twice as many levels take about twice as long, and all values are found."""
    took = []
    for levels in (1000, 4000):
        text = deep(levels, opening, closing)
        began = time.perf_counter()
        spans = secrets.scan(text)
        took.append(time.perf_counter() - began)
        assert sum(text[a:b].strip("\"'").endswith("x") or k == "assign" for k, a, b in spans) >= levels
    assert took[1] < 3 and took[1] < 10 * took[0]


def test_paths_as_one_product():
    """What the stack keeps is the product over the whole path."""
    text = 'auth = {\n  token_store = {\n    vault = { value = "Zx9Qw8RtYu" } } }\nvalue = "Zx9Qw8RtYv"\n[credentials]\nsecret_value = Zx9Qw8RtYw'
    got = [(name, around) for name, around, value in secrets.pairs(text) if name.endswith("value")]
    paths = [("auth", "token_store", "vault"), (), ("credentials",)]
    expected = [1.0, 1.0, 1.0]
    for i, path in enumerate(paths):
        for p in path:
            expected[i] *= 1 - 0.75 * secrets.weigh(p)[1]
    assert [n for n, _ in got] == ["value", "value", "secret_value"]
    assert [a for _, a in got] == pytest.approx(expected)


@pytest.mark.parametrize("text", ["a=" * 100_000, 'a="b"+' * 20_000, "x='" * 100_000, "key: " * 100_000, "k:\n " * 50_000, "{" * 300_000, "<a b='c'" * 50_000, "pwd=" * 100_000])
def test_time_grows_with_length(text):
    began = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - began < 30


def plain_licences(words, ix, threshold=0.6):
    """Labels and the best score by trying every start."""
    labels, best = set(), 0.0
    for k, t in enumerate(licences.TEMPLATES):
        own = [(w, ix.postings[p][1], ix.postings[p][2]) for w, ps in ix.words.items() for p in ps if ix.postings[p][0] == k]
        parts = t.text.split()
        votes = Counter()
        for i, x in enumerate(words):
            for w, place, idf in own:
                if x == w:
                    votes[i - place] += idf
        for s in votes:
            share = sum(votes[s + d] for d in range(licences.SPREAD + 1)) / ix.weight[k]
            if share < threshold - 1e-12:
                continue

            def stands(key):
                key = key.split()
                place = next(i for i in range(len(parts)) if parts[i : i + len(key)] == key)
                starts = [s + licences.SPREAD // 2 + place + d for d in range(-4, 5)]
                return any(a >= 0 and words[a : a + len(key)] == key for a in starts)

            if all(map(stands, t.keys)):
                labels.add(t.label)
                best = max(best, min(1.0, share))
    return labels, best


def test_licences_against_plain(spark):
    rng = random.Random(4)
    plain = "the of and to a in is it you that he was for on are with as his they be at one have this from".split()
    docs = []
    for _ in range(120):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 30))]
        for t in rng.sample(licences.TEMPLATES, rng.randint(0, 2)):
            body = t.text.split()
            for _ in range(rng.choice((0, 0, 1, 3, 8))):
                body[rng.randrange(len(body))] = rng.choice(plain)
            if rng.random() < 0.3:
                body.insert(rng.randrange(len(body)), "so")
            words += body[: rng.choice((len(body), len(body), len(body) // 2))] + [rng.choice(plain) for _ in range(rng.randint(0, 9))]
        docs.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs)), DOC)
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", d) for d in docs]
    wanted = {w for t in licences.TEMPLATES for w in t.text.split()}
    counted = Counter(w for d in split for w in set(d) & wanted)
    assert licences.frequencies(df.select(licences.words_of(df["text"]).alias("words"))) == counted
    ix = licences.index(counted)
    seen = Counter()
    for r in licences.scan(df).collect():
        labels, best = plain_licences(split[r["doc_id"]], ix)
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == labels | base
        assert abs(r["score"] - (1.0 if base else best)) < 1e-9
        seen.update(labels)
    assert len(seen) > 10


def test_long_texts_take_linear_time(spark):
    """Four times the words take far less than sixteen times as long, also where common words have to serve as rare ones."""
    rng = random.Random(1)
    plain = "the of and to a in is it you that was for on are with as this from by not or any can may if has all no".split()
    taken = []
    for n in (1_000, 16_000, 64_000):  # the first warms up
        df = spark.createDataFrame([(1, " ".join(rng.choice(plain) for _ in range(n))), (2, "software " * n)], DOC)
        began = time.perf_counter()
        assert [r["labels"] for r in licences.scan(df).collect()] == ["", ""]
        taken.append(time.perf_counter() - began)
    assert taken[2] < 9 * taken[1]


def test_licence_words_on_all_code_points(spark):
    """Words as the pattern on A-Z lower-cased texts finds them; a letter beyond ASCII may be another, but none becomes one of ASCII or parts a word."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [None, "", " ", "-- The END --", "a", "\n\nA\n\nb"]
    texts += ["".join(f"T{chr(c)}k {chr(c)} " for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    for r in df.select("doc_id", licences.words_of(df["text"]).alias("words")).collect():
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
        assert [w if w.isascii() else "" for w in r["words"]] == [w if w.isascii() else "" for w in words]


def test_licence_words_take_little_longer_than_a_split(spark):
    """Cutting texts into words is most of a scan. Taking each word from a matcher, after a table of letters, took more than four times as long as a split."""
    df = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "repeat('Unter dem Gesetz über Software, Version 2.0 (März). ', 2000) AS text").localCheckpoint()

    def seconds(words):
        def once():
            began = time.perf_counter()
            df.select(words.alias("words")).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - began

        return min(once() for _ in range(4))

    assert seconds(licences.words_of(df["text"])) < 3 * seconds(F.split(df["text"], r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def test_least_votes():
    assert licences.least_votes([1.0, 1.0, 1.0, 1.0], 0.5) == 2
    assert licences.least_votes([3.0, 1.0], 0.6) == 1
    assert licences.least_votes([], 0.6) == 1


def test_items_shorter_than_a_seed(spark):
    items = spark.createDataFrame([(1, "The quick brown fox"), (2, "fox"), (3, "日本語の文"), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick brown the fox"), (3, "前日本語の文後"), (4, "")], DOC)
    got = {(r["doc_id"], r["item_id"], r["n_matched"], r["coverage"]) for r in tiling.leaks(docs, items).collect()}
    assert got == {(1, 1, 4, 1.0), (1, 2, 1, 1.0), (2, 2, 1, 1.0), (3, 3, 5, 1.0)}


def test_both_ways_to_tiles(monkeypatch):
    """Pairing all seeds and searching by length give the same tiles."""
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice(("a", "ab", "abcdefgh"))
        item = [rng.choice(letters) for _ in range(rng.randint(3, 25))]
        doc = [rng.choice(letters + "z") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(doc))
            doc[at:at] = item[: rng.randint(1, len(item))]
        items, t = tiling.Items([" ".join(item)], 3), tiling.words_of(pa.array([" ".join(doc)]))
        monkeypatch.setattr(tiling, "PAIRS", 1 << 16)
        paired = tiling.tiled(t, 0, items, 0, 3)
        monkeypatch.setattr(tiling, "PAIRS", -1)
        assert sorted(tiling.tiled(t, 0, items, 0, 3)) == sorted(paired)


def test_repeated_words_do_not_multiply():
    items = tiling.Items(["w " * 500], 5)
    t = tiling.words_of(pa.array(["w " * 200_000, "w " * 32_000]))
    began = time.perf_counter()
    assert list(tiling.matched(t, items, 5, 80)) == [(0, 0, 500, 1, 500), (1, 0, 500, 1, 500)]
    assert time.perf_counter() - began < 20


def test_false_seeds_are_dropped(monkeypatch):
    """Hashes that are all equal propose everything; words decide."""
    items, t = tiling.Items(["a b c d e f"], 5), tiling.words_of(pa.array(["u v w x y z", "a b c d e f"]))
    different, first, of_item, at_item = items.seeds[5]
    items.seeds[5] = np.zeros(1, np.uint64), np.array([0, at_item.size]), of_item, at_item
    monkeypatch.setattr(type(t), "windows", lambda self, k, which=0: (np.zeros(max(0, self.starts.size - k + 1), np.uint64), self.doc[: self.starts.size - k + 1] == self.doc[k - 1 :]))
    assert list(tiling.matched(t, items, 5, 80)) == [(1, 0, 6, 1, 6)]
