"""Fuzzy line deduplication with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.work import Work

#: Lines of so many words, or of so many letters and digits, are compared; two of this edit similarity are alike.
MIN_WORDS, MIN_CHARS, SIMILARITY = 5, 20, 0.8
#: Word pairs of a line, those of the least hashes, that vote on its fingerprint; an odd number below 2 ** (WIDTH - 1).
SAMPLE = 15
#: Bits of a fingerprint, vote counters in a long, bits of a counter.
BITS, LANES, WIDTH = 60, 12, 5
#: Least word-pair hashes that make cells, and how many of them two lines of a cell share.
SKETCH, SHARED = 5, 3
#: Lines of a cell that are compared pair by pair at once; larger cells are crowds, linked in stars before the pairs that are left.
DENSE = 64
#: Lines of a crowd that a task pairs with others at a time.
BLOCK = 256
#: Next longer lines of its block that a line of a crowd is paired with before the pairs that are left.
NEAR = 4
#: Characters that are counted one by one for the bound on edits; all others count as one kind.
LETTERS = " etaoinsrhldcum"
#: Rounds of one pair of any two groups before all pairs that are left.
ROUNDS = 1
#: Lines that a broadcast list of places may name (some 32 bytes each); with more, the list is joined by a shuffle.
LISTED = 500_000


def words_of(line: Column) -> Column:
    """The normalised line: its lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _votes(sample: str) -> list[Column]:
    """Sums of the sampled hashes' bits, ``LANES`` counters in a long: counter j of sum i takes bit ``WIDTH`` j + i."""
    ones, zero = F.lit(sum(1 << (WIDTH * j) for j in range(LANES))), F.lit(0).cast("long")
    return [F.aggregate(sample, zero, lambda n, h: n + F.shiftright(h, i).bitwiseAND(ones)).alias(f"v{i}") for i in range(WIDTH)]  # noqa: B023


def _fingerprint(sample: str) -> Column:
    """Bit b is one if more than half of the sampled hashes have it.

    What is added to all counters of a long lifts those over half to their
    highest bit, so the bits come out together: an expression a bit would make a
    method too long for the JVM's compiler.
    """
    ones, out = F.lit(sum(1 << (WIDTH * j) for j in range(LANES))), F.lit(0).cast("long")
    lift = (F.lit((1 << (WIDTH - 1)) - 1).cast("long") - F.shiftright(F.size(sample), 1)) * ones
    for i in range(WIDTH):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"v{i}") + lift, WIDTH - 1).bitwiseAND(ones), i))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc, print, pos, k1, k2, chars, bits, sketch)``: every compared line, the 96-bit hash of its words, the length they are compared at, their SimHash and the least hashes of its word pairs.

    Needs columns ``doc``, ``print``, ``text``. A line's words are hashed, each
    hash is joined with the next word's, and the least ``SAMPLE`` of these are a
    sample of the line that other lines with the same word pairs share. All of
    it is computed within the row: nothing is exploded to words, nothing shuffled.
    ``sketch`` is null of lines that are too short. They are to be filtered once
    the rows are written: here, the filter would be pushed below the formulas.
    """
    lines = docs.select("doc", "print", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.octet_length("line") >= 2 * MIN_WORDS - 1)
    lines = lines.select("doc", "print", "pos", words_of(F.col("line")).alias("words"))
    enough = F.when(F.size("words") >= MIN_WORDS, True).otherwise(F.length(F.array_join("words", "")) >= MIN_CHARS)
    lines = lines.select("doc", "print", "pos", F.length(F.array_join("words", " ")).alias("chars"), F.when(enough, F.transform("words", lambda w: F.xxhash64(w))).alias("h"))
    both = F.transform("h", lambda h, i: F.shiftleft(h, 7).bitwiseXOR(F.coalesce(F.get("h", i + 1), F.lit(0).cast("long"))))
    least = lines.select("doc", "print", "pos", "chars", "h", F.slice(F.sort_array(F.array_distinct(both)), 1, SAMPLE).alias("sample"))
    # votes in a projection of their own, each is read by all of its counters
    least = least.select("*", *_votes("sample"))
    return least.select("doc", "print", "pos", F.xxhash64("h").alias("k1"), F.hash("h").alias("k2"), "chars", _fingerprint("sample").alias("bits"), F.slice("sample", 1, SKETCH).alias("sketch"))


def _cells() -> Column:
    """Hashes of every ``SHARED`` of the sketch (of a shorter one, of all), and of either half of the fingerprint."""
    some = [F.when(F.size("sketch") > max(c), F.xxhash64(*[F.get("sketch", F.lit(i)) for i in c])) for c in combinations(range(SKETCH), SHARED)]
    short = F.when(F.size("sketch") < SHARED, F.xxhash64("sketch", F.lit("short")))
    half = (1 << (BITS // 2)) - 1
    halves = [F.xxhash64(F.lit(k), F.col("bits").bitwiseAND(F.lit(mask))) for k, mask in (("low", half), ("high", half << (BITS // 2)))]
    return F.array_distinct(F.array_compact(F.array(*some, short, *halves)))


def candidates(lines: DataFrame, work: Work, dense: int = DENSE) -> DataFrame:
    """Pairs ``(a, b)`` of ``line`` numbers that share a cell; of crowds, a star and the next in length. All lines of crowds stay in table ``shared``.

    Lines meet in the cells of the pigeonhole blocks: halves of the fingerprint,
    of which one is the same if the other takes all changes, and threes of the
    five least word-pair hashes - one replaced word changes two pairs at most, so
    three stay. In a cell of up to ``dense`` lines these are all pairs. Of a
    crowd, each line is paired with the least one and, in its block of lines
    that are about as long, with the ``NEAR`` next longer ones; the other pairs
    are left to ``_crowd_links``, which knows the groups that are found by then.
    """
    rows = lines.select("line", "chars", F.explode(_cells()).alias("cell"))
    size = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("line").alias("heart")).where("n > 1")
    shared = work.table(rows.join(size, "cell"), "shared")
    few = shared.where(F.col("n") <= dense).select("cell", "line")
    met = few.alias("l").join(few.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (F.col("l.line") < F.col("r.line")))
    crowd = shared.where(F.col("n") > dense)
    star = crowd.where("line <> heart").select("heart", "line")
    by_length = Window.partitionBy("cell", _band(), _block()).orderBy("chars", "line")
    near = crowd.select("line", F.array(*[F.lead("line", k).over(by_length) for k in range(1, NEAR + 1)]).alias("next"))
    near = near.select("line", F.explode("next").alias("next")).where("next is not null").select(F.least("line", "next"), F.greatest("line", "next"))
    return work.table(met.select(F.col("l.line").alias("a"), F.col("r.line").alias("b")).union(star).union(near).distinct(), "pairs")


def _band() -> Column:
    """Number of the length: a factor of 1.26 a band, so that alike lines, which differ by a fifth at most, are a band apart at most."""
    return F.floor(F.log("chars") / F.log(F.lit(1.26)))


def _block() -> Column:
    """The part, of some ``BLOCK`` lines, of a crowd of ``n`` that a line is dealt to."""
    return F.pmod(F.xxhash64("line"), F.ceil(F.col("n") / BLOCK))


def _crowd_links(groups: DataFrame, norm: DataFrame, work: Work, dense: int) -> DataFrame:
    """Pairs ``(a, b)`` of alike lines of different ``groups`` that share a crowd: every such pair is compared.

    Crowds of one group have none. Lines meet by crowd and by length, since
    alike ones differ by a fifth at most; large crowds are dealt out in blocks. A
    pair of several crowds is compared in the first, and only if the counts of
    characters of its lines leave room for it (see ``_apart``). Texts are shuffled
    once a crowd and not once a pair.
    """
    named = work.read("shared").where(F.col("n") > dense).join(groups.withColumnRenamed("node", "line"), "line", "left").withColumn("group", F.coalesce("component", "line"))
    mixed = named.groupBy("cell").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("cell")
    # of a line: its group, length and the crowds it is in
    members = named.join(mixed, "cell").groupBy("line", "group", "chars").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    members = work.table(members.join(norm, "line").withColumn("bag", _bag()), "members")
    own = members.select("*", F.explode("cells").alias("c"), _band().alias("band")).select("*", "c.cell", "c.n").drop("c")
    x = own.select("cell", _block().alias("block"), "band", F.col("line").alias("a"), F.col("group").alias("g"), F.col("chars").alias("n"), F.col("cells.cell").alias("in_a"), F.col("norm").alias("x"), F.col("bag").alias("bag_a"))
    y = own.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)).alias("block"), "band", F.col("line").alias("b"), F.col("group").alias("h"), F.col("chars").alias("m"), F.col("cells.cell").alias("in_b"), F.col("norm").alias("y"), F.col("bag").alias("bag_b"))
    y = y.select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("_band")).drop("band").withColumnRenamed("_band", "band")
    # few bytes and much work: dealt out by number
    spark, on = norm.sparkSession, ["cell", "block", "band"]
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = x.repartition(tasks, *on).join(y.repartition(tasks, *on), on).where("a < b and g <> h").where(F.abs(F.col("n") - F.col("m")) <= _limit())
    both = both.where(_apart() <= _limit()).where(F.col("cell") == F.element_at(F.array_intersect("in_a", "in_b"), 1))
    # written before they are filtered, as in alike()
    return work.table(_verdicts(both), "crowd-links").where("good").select("a", "b")


def _bag() -> Column:
    """How often each of ``LETTERS`` is in ``norm``, and how many others."""
    counts = [F.length("norm") - F.length(F.replace("norm", F.lit(c))) for c in LETTERS]
    return F.array(*counts, F.length("norm") - reduce(Column.__add__, counts))


def _apart() -> Column:
    """Edits that lines of lengths ``n`` and ``m`` need at least: one takes one character at most out of a bag and puts one in at most."""
    out = reduce(Column.__add__, [F.greatest(F.get("bag_a", F.lit(i)) - F.get("bag_b", F.lit(i)), F.lit(0)) for i in range(len(LETTERS) + 1)])
    # named once: a longer condition would be too long for the JVM's compiler
    return out + F.greatest(F.lit(0), F.col("m") - F.col("n"))


def alike(lines: DataFrame, texts, work: Work, dense: int = DENSE) -> DataFrame:
    """``(node, component)`` of all lines that are alike to another; ``texts`` gives ``(line, norm)`` of ``line`` numbers.

    First each line is compared with its least partner, then ``ROUNDS`` times
    one pair of any two groups. Pairs within a group that these comparisons
    connect cannot change it and are left out; all others are compared, those of
    crowds last. Groups found so far enter the next components as stars around
    their least line.
    """
    rest = candidates(lines, work, dense)
    norm = texts(rest.select(F.explode(F.array("a", "b")).alias("line")).distinct())
    some, groups = rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), None
    join = lambda good, name: work.table(components(good if groups is None else good.union(groups.where("node <> component").select("node", "component")), work, name), name)
    for k in range(ROUNDS + 2):
        some = work.table(some, f"some-{k}")
        # written first: a filter on "good" would be pushed below the spreading by number, where tasks go by bytes
        good = work.table(_judge(some, norm), f"judged-{k}").where("good").select("a", "b")
        if groups is None or not good.isEmpty():
            groups = join(good, f"groups-{k}")
        if k > ROUNDS:
            break
        of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))  # noqa: B023, E731
        named = rest.join(some, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        named = named.select("a", "b", F.coalesce("a_group", "a").alias("a_group"), F.coalesce("b_group", "b").alias("b_group"))
        named = work.table(named.where("a_group <> b_group"), f"rest-{k}")
        rest = named.select("a", "b")
        if named.isEmpty():
            break
        one = named.groupBy(F.least("a_group", "b_group").alias("g"), F.greatest("a_group", "b_group").alias("h")).agg(F.min(F.struct("a", "b")).alias("p"))
        some = one.select("p.*") if k < ROUNDS else rest
    good = _crowd_links(groups, norm, work, dense)
    return groups if good.isEmpty() else join(good, "groups-crowds")


def _limit() -> Column:
    """Edits that lines of lengths ``n`` and ``m`` may need: a fifth of the longer."""
    return F.floor(F.greatest("n", "m") * F.lit(1 - SIMILARITY) + 1e-9)


def _good() -> Column:
    """Whether ``x`` and ``y``, of lengths ``n`` and ``m``, are within the limit."""
    limit = _limit()
    # levenshtein() takes a constant bound, below which it keeps to a band, and gives -1 beyond: narrow bands first, then the least that holds the limit
    within = lambda bound: F.levenshtein("x", "y", bound).bitwiseAND(F.lit(0x7FFFFFFF)) <= limit
    good = F.levenshtein("x", "y") <= limit
    for bound in reversed([int(6 * 1.4**k) for k in range(23)]):
        tried = within(bound) if bound < 64 else within(bound // 4) | within(bound) if bound < 512 else within(bound // 32) | within(bound // 8) | within(bound // 3) | within(bound)
        good = F.when(limit <= bound, tried).otherwise(good)
    return good


def _judge(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """``(a, b, good)``: whether the edits between two normalised lines are at most a fifth of the longer."""
    x = norm.select(F.col("line").alias("a"), F.col("norm").alias("x"), F.length("norm").alias("n"))
    y = norm.select(F.col("line").alias("b"), F.col("norm").alias("y"), F.length("norm").alias("m"))
    # pairs are few bytes and much work: spread by number, not by size
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = pairs.join(x, "a").join(y, "b").where(F.abs(F.col("n") - F.col("m")) <= _limit()).repartition(tasks)
    return _verdicts(both)


def _verdicts(both: DataFrame) -> DataFrame:
    """``(a, b, good)`` of rows of two lines ``x`` and ``y``, their lengths ``n`` and ``m``.

    Most alike lines are so word by word, which is seen in one pass over the
    words; levenshtein() takes the product of the lengths even for few edits. It
    decides of all others.
    """
    both = both.select("a", "b", "x", "y", "n", "m", F.split("x", " ").alias("xs"), F.split("y", " ").alias("ys"))
    return both.select("a", "b", F.when(_by_words() <= _limit(), True).otherwise(_good()).alias("good"))


def _by_words() -> Column:
    """Edits that are enough to turn words ``xs`` into ``ys``: words are replaced, left out and put in, whichever makes the next words the same.

    Each word counts with a space behind it, and a replaced one as the longer of
    the two. It is a bound: other ways may need fewer edits, none are forgotten.
    """

    def step(s, i):
        w, following = F.get("xs", i), F.get("xs", i + 1)
        y0, y1, y2 = (F.get("ys", s["j"] + k) for k in range(3))
        state = lambda j, used, cost: F.struct((s["j"] + j).alias("j"), (s["used"] + used).alias("used"), (s["cost"] + cost).alias("cost"))
        l0, l1, l2, own = F.length(y0) + 1, F.length(y1) + 1, F.length(y2) + 1, F.length(w) + 1
        out = F.when(w == y0, state(1, l0, 0)).when(w == y1, state(2, l0 + l1, l0)).when(y0.isNull() | (following == y0), state(0, 0, own))
        return out.when(w == y2, state(3, l0 + l1 + l2, l0 + l1)).otherwise(state(1, l0, F.greatest(l0, own) - 1))

    start = F.struct(F.lit(0).alias("j"), F.lit(0).alias("used"), F.lit(0).alias("cost"))
    return F.aggregate(F.sequence(F.lit(0), F.size("xs") - 1), start, step, lambda s: s["cost"] + F.length("y") + 1 - s["used"])


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, print, gone)``: places of the lines that each document loses, of those that lose any."""
    spark = docs.sparkSession
    work = Work(spark, "lines")
    own = _own(docs, id_col, text_col)
    found = work.table(signatures(own.where(F.length("text") >= 2 * MIN_WORDS - 1)), "occurrences").where("sketch is not null")
    at = F.struct("doc", "print", "pos")
    lines = found.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.min("chars").alias("chars"), F.min("bits").alias("bits"), F.min("sketch").alias("sketch"), F.count("*").alias("n"))
    lines = work.table(lines.withColumn("line", F.monotonically_increasing_id()), "lines")
    found = found.select("doc", "print", "pos", "k1", "k2")

    def texts(wanted: DataFrame) -> DataFrame:
        places = work.table(lines.join(wanted, "line").select("line", "first.*"), "places")
        by_doc = places.groupBy(F.col("doc").alias("_doc"), F.col("print").alias("_print")).agg(F.map_from_entries(F.collect_set(F.struct("pos", "line"))).alias("line"))
        if places.count() <= LISTED:
            by_doc = F.broadcast(by_doc)
        some = own.join(by_doc, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("print") == F.col("_print")))
        again = some.select("line", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("line", F.try_element_at("line", F.col("pos")))
        norm = again.where("line is not null").select("line", F.array_join(words_of(F.col("text")), " ").alias("norm"))
        return work.table(norm.dropDuplicates(["line"]), "texts")

    groups = alike(lines, texts, work).select(F.col("node").alias("line"), "component")
    # lines of which one occurrence stays: those in a group, or found more than once
    many = lines.join(groups, "line", "left").where("component is not null or n > 1")
    many = many.select("k1", "k2", "first", F.coalesce("component", "line").alias("component"))
    best = many.groupBy("component").agg(F.min("first").alias("best"))
    many = many.join(best, "component").select("k1", "k2", "best")
    gone = found.join(many, ["k1", "k2"])
    gone = gone.where(~F.struct("doc", "print", "pos").eqNullSafe(F.col("best")))
    return work.table(gone.groupBy("doc", "print").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every line but one of each group of alike lines taken out of the texts.

    Lines are what stands between line ends ``\\n``. They are compared by their
    words, lower-cased letters and digits; lines of fewer than ``MIN_WORDS``
    words and fewer than ``MIN_CHARS`` characters are left alone. Lines of the
    same words are alike, and so are two that need edits of at most a fifth of
    the longer one and meet in a cell (see ``candidates``; the README has the
    recall against edit distance alone). Of each connected group the occurrence in
    the smallest (id, then text hash, then place) stays. With ``counts``, columns
    ``n_lines`` and ``n_removed`` are added.

    Null texts stay null (no lines, none removed), empty ones have one empty
    line; a document all of whose lines go keeps an empty text. Repeated rows
    (same id, same text) are one document: each keeps the same lines. Null ids
    are the smallest. An empty table gives an empty table.
    """
    gone = removed_lines(docs, id_col, text_col).select(F.col("doc").alias("_doc"), F.col("print").alias("_print"), F.col("gone").alias("_gone"))
    key = F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(text_col) == F.col("_print"))
    joined = docs.join(gone, key, "left")
    parts = F.split(text_col, "\n")
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    columns = [F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        columns += [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).alias("n_lines")]
        columns += [F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed")]
    return joined.select(*columns)
