import hashlib
import itertools
import math
import random
import re

import numpy as np

from gridloom.llm import secret_scan
from gridloom.llm.secret_scan import BEGIN, INSIDE, OUTSIDE, SHAPE, WIDTH, Crf, Shapes, base_spans, clipped, fit, learn, run_labels, scan, shape, text_features, varied, written

SCHEMA = "doc_id long, text string, spans string"
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def noise(rng):
    parts = ["token", "TOKEN", "toKen", "api_key", "ApiKey", "secret", "ſecret", "=", ": ", '"', "'", " ", "abc", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\n", "passwd", "password", "/", "-", "deadbeef" * 3]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_base_spans_against_brute_force():
    rng = random.Random(3)
    for text in [noise(rng) for _ in range(5000)] + ["", "token: token: abcdef", "token=" + "a" * 100_000, "f" * 50_000]:
        assert [(s, k, e) for s, k, e, _, _ in base_spans(text)] == plain_base(text)


def test_tokens_cover_all_but_blanks():
    rng, shapes = random.Random(4), Shapes()
    for text in [noise(rng) for _ in range(2000)] + ["", " \n", "a" * 5000 + " b", "長い é_x = 'p@ss!'"]:
        x, starts, ends = text_features(text, shapes)
        assert x.shape == (len(starts), WIDTH)
        assert "".join(text[a:b] for a, b in zip(starts, ends)) == "".join(text.split())


def test_short_way_of_shapes_is_the_long_one():
    """A letter in upper case takes the long way; what it shows beside its case is the same."""
    for word in ["token", "éa", "deadbeef", "deadbeefs", "a", "averyveryverylongwordofletters"]:
        short, long = shape(word), shape(word[0].upper() + word[1:])
        same = [i for i in range(len(short)) if i != 3]
        assert len(short) == SHAPE + 5
        assert [short[i] for i in same] == [long[i] for i in same]


def test_path_of_a_text_is_that_of_its_whole_chain():
    rng = np.random.default_rng(7)
    for n in [0, 1, 2, *rng.integers(3, 60, 300)]:
        step = rng.normal(size=(3, 3)) / 4
        step[OUTSIDE, INSIDE] = -1e4
        crf = Crf(rng.normal(size=(WIDTH + 1, 3)), step)
        scores = rng.normal(size=(n, 3)) * 2 + np.array([2, 0, 0])
        tags = crf.path(scores) if n else []
        want = [(i, next((j for j in range(i + 1, n) if tags[j] != INSIDE), n)) for i in range(n) if tags[i] == BEGIN]
        assert crf.decode_text(scores) == want


def test_clipped():
    text = "abcdefghij"
    base = [(2, 0, 4, 2, 4), (3, 2, 6, 3, 6)]
    assert clipped(0, 10, base, text) == [(0, 2), (6, 10)]
    assert clipped(2, 6, base, text) == [] and clipped(6, 8, base, text) == [(6, 8)] and clipped(3, 7, base, text) == [(6, 7)]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        crf = Crf(rng.normal(size=(WIDTH + 1, 3)), rng.normal(size=(3, 3)))
        x = rng.normal(size=(4, WIDTH))
        s = crf.scores(x)

        def value(path):
            return sum(crf.step[a, b] + row[b] for a, b, row in zip((OUTSIDE, *path), path, s))

        assert tuple(crf.decode(x)) == max(itertools.product(range(3), repeat=4), key=value)


def test_training_learns_a_rule():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(300):
        x = rng.random((3, WIDTH))
        secret = x[0, 0] > 0.5
        runs.append((x, [BEGIN, INSIDE, INSIDE] if secret else [OUTSIDE] * 3))
    crf = fit(runs)
    assert np.mean([crf.decode(x) == y for x, y in runs]) > 0.9
    assert fit([]).decode(np.zeros((2, WIDTH))) == [OUTSIDE, OUTSIDE]


def test_labels():
    assert run_labels([(0, 3), (3, 4), (4, 9), (9, 12)], [(3, 9)]) == [OUTSIDE, BEGIN, INSIDE, OUTSIDE]


def secret(rng):
    letters = rng.choice(["0123456789abcdef", "ABCDEFGHIJabcdefghij0123456789"])
    return "".join(rng.choice(letters) for _ in range(40))


def test_scan(spark):
    rng = random.Random(5)
    texts = [f'some words here token = "{secret(rng)}" and 4785380592391139 or 152.143.123.131 more' for _ in range(60)]
    odd = "".join(rng.choice("ABCDEFabcdef0123456789") for _ in range(40))
    texts += [None, "", f'client_auth = "{odd}" end', "nothing 12 at all", "é" * 10 + f"password: {secret(rng)}", "w " * 60_000 + "AKIA" + "A1" * 10]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(0, texts[0], ""), (None, "token=abcdefg", "")]
    got = scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        base = plain_base(t or "")
        r = by[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(every)
    tagged = [s for s in by[62].spans.split(",") if s.startswith("crf")]
    at = texts[62].index(odd)
    assert tagged == [f"crf:{at}:{at + 40}"]
    assert not any("crf" in by[i].spans for i in range(60))


def test_empty(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []
    assert learn(spark.createDataFrame([(1, "no digits", "")], SCHEMA)).decode(np.zeros((1, WIDTH))) == [OUTSIDE]
    assert written([]) == ""


def test_made_up_secrets_stand_where_they_say():
    rng = random.Random(8)
    text = "x" * 500 + ' token = "abcdef123456" ' + "y" * 500
    for _ in range(200):
        got, a, b = varied(text, 501, 523, rng)
        assert 8 <= b - a <= 90 and not re.search(r"\s", got[a:b]) and got[:200] == text[301:501]


def test_few_tokens_need_a_path(monkeypatch):
    """Tokens that no neighbour can make part of a secret are left out of the search, and it still finds the best path."""
    step = np.array([[2.0, -2.0, secret_scan.NEVER], [-1.0, -3.0, 2.0], [1.0, -1.0, 1.0]])
    crf = secret_scan.Crf(np.zeros((secret_scan.WIDTH + 1, 3)), step)
    scores = np.tile([10.0, 0.0, 0.0], (1000, 1))
    scores[500:503] = [[0, 9, 0], [0, 0, 9], [3, 0, 9]]
    whole, asked, path = crf.path(scores), [], crf.path
    monkeypatch.setattr(crf, "path", lambda part: asked.append(len(part)) or path(part))
    assert crf.decode_text(scores) == [(500, 503)] and [i for i, tag in enumerate(whole) if tag] == [500, 501, 502]
    assert sum(asked) < 10


def test_shape_of_bytes_and_of_characters_agree():
    """A token of ASCII shows the same as one that is looked at character by character."""
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("abcdefXYZ0189_+/.-=:\"'{}") for _ in range(rng.randint(1, 40)))
        s = secret_scan.shape(t)
        assert s[0] == (not any(c.isalnum() for c in t)) and s[6] == sum(c.isdigit() for c in t) / len(t)
        assert s[10] == sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:])) / len(t)
        assert s[9] == (len(t) >= 8 and all(c in "0123456789abcdefABCDEF" for c in t))
        assert abs(s[3] * 6 + sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))) < 1e-9
