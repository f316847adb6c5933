import inspect
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup
from gridloom.llm.line_dedup import candidates, dedup_lines, signatures
from gridloom.llm.work import Work

SCHEMA = "doc_id long, text string, pos int, gone string"


def norm(line):
    return re.findall(r"[^\W_]+", line.lower())


def compared(line):
    return len(norm(line)) >= 5 or len("".join(norm(line))) >= 20


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(spark, rows):
    """Texts after deduplication by edit distance alone; only the order of a document's texts, their hash, is taken from the engine."""
    table = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(rows)], "doc long, text string")
    prints = {r.doc: r.p for r in table.select("doc", F.xxhash64("text").alias("p")).collect()}
    rank = {i: (r[0] is not None, r[0] if r[0] is not None else 0) for i, r in enumerate(rows)}
    lines = [((*rank[i], prints[i], pos), i, pos, " ".join(norm(line))) for i, (_, t, *_) in enumerate(rows) if t is not None for pos, line in enumerate(t.split("\n")) if compared(line)]
    label, seen = list(range(len(lines))), {}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, (_, _, _, u) in enumerate(lines):
        for y, (_, _, _, v) in enumerate(lines[:x]):
            limit = 0.2 * max(len(u), len(v)) + 1e-9
            if u == v or abs(len(u) - len(v)) <= limit and len(u) < 5000 and seen.setdefault((u, v), levenshtein(u, v)) <= limit:
                label[root(x)] = root(y)
    best = {}
    for x, line in enumerate(lines):
        best[root(x)] = min(best.get(root(x), line[0]), line[0])
    gone = {(i, p) for x, (at, i, p, _) in enumerate(lines) if at != best[root(x)]}
    return sorted(((r[0], None if r[1] is None else "\n".join(line for p, line in enumerate(r[1].split("\n")) if (i, p) not in gone)) for i, r in enumerate(rows)), key=str), len(gone)


def case():
    rng = random.Random(6)
    vocabulary = [f"wo{i}rd" for i in range(300)]
    long = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for d in range(50):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 5))]
        variant = list(long)
        variant[rng.randrange(60)] = rng.choice(vocabulary)
        lines += [" ".join(variant)] if d % 2 else []
        lines += ["The same old line, again and AGAIN!" if d % 3 else "the same: old line again and again"]
        lines += ["too short"]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    rows = [(d, t, 3, "x") for d, t in enumerate(texts)]
    rows += [(100, None, 1, ""), (101, "", 1, ""), (102, "\n\n", 1, ""), (None, texts[1], 1, ""), (3, texts[3], 1, "again"), (3, texts[4], 1, "other text"), (103, "é ü ö ä ß\nÉ Ü  Ö\tÄ ß \n" * 3, 1, ""), (104, "many words here in one line " * 5000, 1, "")]
    return rows


ALIKE = line_dedup.alike


@pytest.mark.parametrize("dense", [64, 2])
def test_against_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(line_dedup, "alike", lambda lines, texts, work: ALIKE(lines, texts, work, dense))
    rows = case()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = dedup_lines(df, counts=True)
    want, gone = brute(spark, rows)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    found = got.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == want
    assert sum(r.n_removed for r in found) == gone > 60
    assert all(r.n_lines == (0 if r.text is None else len(r.text.split("\n")) + r.n_removed) or r.text == "" for r in found)


def test_plain_cases(spark):
    line = "a line of quite enough words"
    df = spark.createDataFrame([(2, f"{line}\nkept", 1, ""), (1, line.upper(), 1, ""), (3, line, 1, ""), (3, line, 2, "")], SCHEMA)
    assert sorted(map(tuple, dedup_lines(df).select("doc_id", "text").collect())) == [(1, line.upper()), (2, "kept"), (3, ""), (3, "")]
    assert dedup_lines(df.where("false"), counts=True).collect() == []
    unspaced = "長い一行の文で空白がまったくないものも比べられる対象になる"
    assert removed(spark, [unspaced, "x", unspaced, "x"]) == {2}


def test_main_path_is_native(spark):
    source = inspect.getsource(line_dedup)
    assert not re.search(r"udf|InPandas|InArrow|\.rdd|pandas|pyarrow", source)


def removed(spark, texts):
    """Documents of one line each that lose it."""
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id for r in dedup_lines(df, counts=True).where("n_removed > 0").collect()}


def test_recall_on_replaced_words(spark):
    """Pairs at edit similarity 0.8 that edit distance alone would find; one word is replaced in lines of 8, 12 and 20."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((3, 6, 7, 8))))
    texts, pairs = [], []
    for n in (8, 12, 20) * 70:
        line = [word() for _ in range(n)]
        other = list(line)
        other[rng.randrange(n)] = word()
        a, b = " ".join(line), " ".join(other)
        if levenshtein(a, b) <= 0.2 * max(len(a), len(b)):
            pairs.append(len(texts) + 1)
            texts += [a, b]
    got = removed(spark, texts)
    assert got <= set(pairs) and len(pairs) > 180
    assert len(got) >= 0.9 * len(pairs)


def test_signatures(spark):
    """Every compared line has a fingerprint and a sketch; both follow from the hashes of its words."""
    rng = random.Random(2)
    texts = ["it is as if he or we had to go up", "a b c d e", "a a a a a a", "長い一行の文で空白がまったくないものも比べられる対象になる", "short"] + [" ".join(str(rng.randrange(10**4)) for _ in range(n)) for n in (31, 64, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("print", F.lit(0).cast("long"))
    got = {r.doc: r for r in signatures(df).collect()}
    words = sorted({w for t in texts for w in norm(t)})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    signed = lambda v: (v & (1 << 64) - 1) - ((v & 1 << 63) << 1)
    for doc, text in enumerate(texts):
        if not compared(text):
            assert doc not in got or got[doc].sketch is None
            continue
        hashes = [h[w] for w in norm(text)]
        sample = sorted({signed(a << 7) ^ b for a, b in zip(hashes, [*hashes[1:], 0])})[:15]
        assert got[doc].sketch == sample[:5]
        assert got[doc].bits == sum((sum(v >> b & 1 for v in sample) * 2 > len(sample)) << b for b in range(60))


def test_cells_make_few_pairs_of_a_crowd(spark):
    """Near copies of one line: linear in their number, and still one group."""
    rng = random.Random(3)
    base = [f"word{i}" for i in range(40)]
    texts = sorted({" ".join([*base[:k], f"x{rng.randrange(10**6)}", *base[k + 1 :]]) for _ in range(400) for k in [rng.randrange(40)]})
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    lines = signatures(df.select(F.col("doc_id").alias("doc"), F.lit(0).alias("print"), "text")).withColumn("line", F.col("doc"))
    work = Work(spark, "test")
    lines = work.table(lines, "lines")
    assert candidates(lines, work, 8).count() < 400 * 8 * 42 / 2
    assert dedup_lines(df, counts=True).agg(F.sum("n_removed")).first()[0] == len(texts) - 1


def test_crowds_lose_no_link(spark):
    """A crowd whose lines are alike in twos only: no star around one line finds them, and one fingerprint block in common is not needed."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = []
    for _ in range(40):
        line = [word() for _ in range(30)]
        other = list(line)
        for i in rng.sample(range(30), 5):
            other[i] = word()
        texts += [" ".join(line), " ".join(other)]
    assert all(levenshtein(a, b) <= 0.2 * len(b) for a, b in zip(texts[::2], texts[1::2]))
    df = spark.createDataFrame(list(enumerate(texts)), "line long, text string").select("line", "text", F.length("text").alias("chars"), F.xxhash64("line").alias("r"))
    # all share one cell; fingerprints are any
    lines = df.select("line", "chars", F.col("r").bitwiseAND(F.lit((1 << 60) - 1)).alias("bits"), F.array(*[F.lit(i).cast("long") for i in range(5)]).alias("sketch"))
    groups = line_dedup.alike(lines, lambda wanted: df.join(wanted, "line").select("line", F.col("text").alias("norm")), Work(spark, "test"), 8)
    assert {(r.node, r.component) for r in groups.collect()} == {(i, i - i % 2) for i in range(80)}


def test_words_are_letters_and_digits(spark):
    line = "one well-known line of (some) plain words"
    assert removed(spark, [line, "• One well–known line — of [some] “plain” words …"]) == {1}


def test_long_lines_are_judged_in_bands(spark):
    """Distances on both sides of the limit, at lengths whose limit is beyond each of the bounds up to 1024."""
    rows = [(f"{n}:{d}", "a" * n, "b" * d + "a" * (n - d)) for n in (60, 400, 1600, 6000) for d in (3, n // 10, n // 5, n // 5 + 1, n // 2)]
    norm_ = spark.createDataFrame([(2 * i + j, r[1 + j]) for i, r in enumerate(rows) for j in (0, 1)], "line long, norm string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(rows))], "a long, b long")
    got = {rows[r.a // 2][0] for r in line_dedup._judge(pairs, norm_).where("good").collect()}
    assert got == {name for name, x, y in rows if int(name.split(":")[1]) <= len(x) // 5}


def test_words_bound_edits(spark):
    """What the words and the counts of characters say is on either side of the edit distance; near copies are seen by their words alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijä") for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(300):
        x = [word() for _ in range(rng.randint(1, 30))]
        y = [w for w in x for w in rng.choice([[w]] * 12 + [[], [word()], [w, word()], [word(), word(), w]])] or [word()]
        rows.append((i, " ".join(x), " ".join(y)))
    df = spark.createDataFrame(rows, "i long, x string, y string").select("i", "x", "y", F.length("x").alias("n"), F.length("y").alias("m"), F.split("x", " ").alias("xs"), F.split("y", " ").alias("ys"))
    for side, bag in (("x", "bag_a"), ("y", "bag_b")):
        df = df.withColumn("norm", F.col(side)).withColumn(bag, line_dedup._bag()).drop("norm")
    got = df.select("i", line_dedup._apart().alias("least"), line_dedup._by_words().alias("most")).collect()
    edits = {i: levenshtein(x, y) for i, x, y in rows}
    assert len(got) == 300 and all(r.least <= edits[r.i] <= r.most for r in got)
    assert sum(r.most <= 1.3 * edits[r.i] + 1 for r in got) > 150 and sum(2 * r.least >= edits[r.i] > 0 for r in got) > 50


def test_crowds_compare_few_pairs(spark):
    """Unlike lines with a passage in common: few pairs of their crowd are left to be compared, those of two kinds of letters none."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    passage = " ".join(word("abc") for _ in range(10))
    texts = [" ".join(word(letters) for _ in range(20)) + " " + passage for letters in ("hijkl", "mnopr") for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "line long, text string").select("line", "text", F.length("text").alias("chars"), F.xxhash64("line").alias("r"))
    lines = df.select("line", "chars", F.col("r").bitwiseAND(F.lit((1 << 60) - 1)).alias("bits"), F.array(*[F.lit(i).cast("long") for i in range(5)]).alias("sketch"))
    work = Work(spark, "test")
    groups = line_dedup.alike(lines, lambda wanted: df.join(wanted, "line").select("line", F.col("text").alias("norm")), work, 8)
    seen = [(r.a, r.b) for r in work.read("crowd-links").collect()]
    assert groups.collect() == [] and not any(a < 40 <= b for a, b in seen) and len(seen) < 80 * 79 / 2 / 2
