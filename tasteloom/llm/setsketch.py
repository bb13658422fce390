"""Near-duplicates by SetSketch registers: bands, joint likelihood, exact confirmation.

A document's set holds its distinct five-word shingles (lower-cased words; with fewer words the whole
sequence is one shingle). Register i of its sketch is K = floor(1 - log_b(a * x_i)), limited to 16 bits,
where x_i is the smallest of exponential draws of the set's members: registers are exponentially spaced,
truncated minima. The sketch of a union is the larger register of both, and two registers are equal about
as often as the sets resemble each other.

1. Equal sets are one class, led by its smallest ``doc_id`` (of several texts of that id, the one with the smallest
   hash) and named by its place among all leaders; only classes go on.
2. ``ROWS`` registers make a band; classes that share a band meet. In each meeting every class is
   paired with the one that meets most others. The joint likelihood of the counts of larger, smaller and equal registers
   must not speak for a similarity below ``SCREEN``; what remains is confirmed on full sets.
3. Meetings that still hold several components are looked at again: all pairs across components are
   screened inside bounded block tasks, by registers and by samples of the sets, and confirmed.
   So a link that two classes of one meeting have is lost only if it cannot change a component.
4. Components by alternating stars; the component is the smallest ``doc_id``.

At similarity 0.75 a pair misses all 32 bands of four with probability 5e-6; no other step is approximate
but the screens, which lie five standard deviations below.

Null and empty texts (no words) have an empty set and are linked with nothing. Repeated rows get the
same result each; rows that share a ``doc_id`` but not a text are looked at separately. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import grid_apply
from ..operators.ordering import with_position
from ..session import store
from .components import components
from .words import WordHashes, gram_hashes, map_batches, mix, split_words

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100  # linked if 100 * common >= 75 * union
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535  # b, a and the largest register
SCREEN = 0.55
SAMPLE = 384  # names of a set's sample
SAMPLE_SCREEN, WHOLE_SCREEN = 0.64, 0.74  # five standard deviations below; whole sets leave name collisions only
_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_CHUNK = 4096


def shingle_set(text: str | None, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle names."""
    return np.unique(gram_hashes(memo.array(split_words(text, lower=True)), SHINGLE))


def registers(members: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set; the register is a monotone function of the least uniform draw."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(members), _CHUNK):
        # shingle names are mixed already: a multiplication gives each register draws of its own
        draws = members[at : at + _CHUNK, None] * _MULTIPLIERS[None, :]
        np.minimum(least, draws.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    value = -np.log1p(-np.minimum(uniform, 1.0 - 1e-16))
    k = np.floor(1.0 - np.log(RATE * value) / np.log(BASE))
    return (np.clip(k, -(TOP // 2), TOP // 2) + TOP // 2).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band: its four registers side by side, mixed with the band's number."""
    joined = np.ascontiguousarray(sketch.reshape(BANDS, ROWS)).view(np.uint64).ravel()
    return mix(joined + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(977)))


def may_be_similar(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Whether the likelihood's maximum lies at a similarity of ``SCREEN`` or more.

    With u, v the shares of the cardinalities, a register is larger on the left with p(u - v*J) and on
    the right with p(v - u*J), p(x) = -log_b(1 - x*(b-1)/b). The log-likelihood is concave in J, so the
    sign of its derivative at the screen tells on which side the maximum lies.
    """
    u = n_left / (n_left + n_right)
    v = 1.0 - u
    more = (left > right).sum(axis=-1)
    less = (left < right).sum(axis=-1)
    same = left.shape[-1] - more - less
    top = np.minimum(u / v, v / u)  # the largest similarity that the sizes allow
    j = np.minimum(SCREEN, top * (1 - 1e-9))
    scale = (BASE - 1.0) / BASE

    def p(x):
        return -np.log1p(-x * scale) / np.log(BASE)

    def slope(x):
        return scale / (np.log(BASE) * (1.0 - x * scale))

    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    px, py = p(x), p(y)
    rest = np.maximum(1.0 - px - py, 1e-12)
    dx, dy = -v * slope(x), -u * slope(y)
    derivative = more * dx / px + less * dy / py - same * (dx + dy) / rest
    return (top >= SCREEN) & (derivative >= 0)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, d1, d2, sketch)``: hash of the text, set size, digest of the set, registers."""

    def make():
        memo = WordHashes()

        def one(cols: dict) -> dict:
            out: dict = {c: cols[c] for c in ("doc_id", "text_key")} | {"n_shingles": [], "d1": [], "d2": [], "sketch": []}
            for text in cols["text"]:
                members = shingle_set(text, memo)
                out["n_shingles"].append(len(members))
                d1, d2 = set_digest(members)
                out["d1"].append(d1)
                out["d2"].append(d2)
                out["sketch"].append(registers(members).tobytes() if len(members) else None)
            return out

        return one

    schema = "doc_id long, text_key long, n_shingles long, d1 long, d2 long, sketch binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(rows, ("doc_id", "text_key", "text"), make, schema)


def set_digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    if not len(members):
        return 0, 0
    first = mix(members).sum(dtype=np.uint64)
    second = mix(members ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def _bands(classes: DataFrame) -> DataFrame:
    """``(key, rep)``: one row for each band of each class."""

    def make():
        def one(cols: dict) -> dict:
            keys = [band_keys(np.frombuffer(s, np.uint16)).view(np.int64) for s in cols["sketch"]]
            return {
                "key": np.concatenate(keys) if keys else np.zeros(0, np.int64),
                "rep": np.repeat(np.array(cols["rep"], np.int64), BANDS),
            }

        return one

    return map_batches(classes, ("rep", "sketch"), make, "key long, rep long")


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of classes that the likelihood lets pass."""
    side = classes.select("rep", "n_shingles", "sketch")
    for name in ("a", "b"):
        renamed = side.select(*[F.col(c).alias(f"{name}_{c}") for c in side.columns])
        pairs = pairs.join(renamed, F.col(name) == F.col(f"{name}_rep")).drop(f"{name}_rep")

    @F.arrow_udf("boolean")
    def passes(left, right, n_left, n_right):
        if not len(left):
            return pa.array([], pa.bool_())
        x = np.frombuffer(b"".join(left.to_pylist()), np.uint16).reshape(-1, REGISTERS)
        y = np.frombuffer(b"".join(right.to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sizes = (n_left.to_numpy().astype(float), n_right.to_numpy().astype(float))
        return pa.array(may_be_similar(x, y, *sizes))

    return pairs.where(passes("a_sketch", "b_sketch", "a_n_shingles", "b_n_shingles")).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose full sets are similar enough. ``texts`` has ``(rep, text)``."""

    def make():
        memo, last = WordHashes(), {}

        def members(name, text):
            if name not in last:
                if len(last) >= 16:
                    last.clear()
                last[name] = shingle_set(text, memo)
            return last[name]

        def one(cols: dict) -> dict:
            out: dict = {"a": [], "b": []}
            for a, b, x, y in zip(cols["a"], cols["b"], cols["a_text"], cols["b_text"], strict=True):
                left, right = members(a, x), members(b, y)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if DENOMINATOR * common >= NUMERATOR * (len(left) + len(right) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return one

    joined = pairs
    for name in ("a", "b"):
        side = texts.select(F.col("rep").alias(name), F.col("text").alias(f"{name}_text"))
        joined = joined.join(side, name)
    return map_batches(joined, ("a", "b", "a_text", "b_text"), make, "a long, b long")


def member_sample(members: np.ndarray) -> np.ndarray:
    """The ``SAMPLE`` smallest 32-bit names of a set: a small set whole."""
    return np.unique((members >> np.uint64(32)).astype(np.uint32))[:SAMPLE]


def _samples(texts: DataFrame) -> DataFrame:
    """``(rep, sample)`` from ``(rep, text)``."""

    def make():
        memo = WordHashes()

        def one(cols: dict) -> dict:
            return {"rep": cols["rep"], "sample": [member_sample(shingle_set(t, memo)).tobytes() for t in cols["text"]]}

        return one

    return map_batches(texts, ("rep", "text"), make, "rep long, sample binary")


def sample_similarity(left: np.ndarray, right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the similarity of one sample to others, and whether each is of whole sets.

    Below the smaller of the truncated samples' largest names both samples are complete.
    """
    sizes = np.array([len(r) for r in right])
    ends = np.array([r[-1] if len(r) == SAMPLE else 2**32 - 1 for r in right], np.uint64)
    ends = np.minimum(ends, np.uint64(left[-1]) if len(left) == SAMPLE else np.uint64(2**32 - 1))
    flat, starts = np.concatenate(right), np.cumsum(sizes) - sizes
    at = np.minimum(np.searchsorted(left, flat), len(left) - 1)
    inside = flat <= np.repeat(ends, sizes)
    common = np.add.reduceat((left[at] == flat) & inside, starts, dtype=np.int64)
    others = np.add.reduceat(inside, starts, dtype=np.int64)
    mine = np.searchsorted(left, ends, side="right")
    whole = (sizes < SAMPLE) & (len(left) < SAMPLE)
    return common / np.maximum(1, mine + others - common), whole


def _across(crowded: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components within a meeting that both screens let pass.

    The pairs live inside block tasks only: first the joint likelihood of the registers, then the samples,
    which are whole sets for most documents. So the pairs that leave a task are close to real links.
    """
    wanted = crowded.select("rep").distinct()
    samples = store(_samples(texts.join(wanted, "rep", "left_semi")).dropDuplicates(["rep"]))
    side = crowded.join(classes.select("rep", "n_shingles", "sketch"), "rep").join(samples, "rep")
    side = side.select("key", "rep", "component", "n_shingles", "sketch", "sample")

    def kernel(left: dict, right: dict) -> dict:
        x = np.frombuffer(b"".join(left["sketch"]), np.uint16).reshape(-1, REGISTERS)
        y = np.frombuffer(b"".join(right["sketch"]), np.uint16).reshape(-1, REGISTERS)
        members = [np.frombuffer(s, np.uint32) for s in right["sample"]]
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(x)):
            far = np.nonzero((right["component"] != left["component"][i]) & (right["rep"] > left["rep"][i]))[0]
            if not len(far):
                continue
            n_left = np.full(len(far), float(left["n_shingles"][i]))
            near = far[may_be_similar(x[i][None, :], y[far], n_left, right["n_shingles"][far].astype(float))]
            if not len(near):
                continue
            own = np.frombuffer(left["sample"][i], np.uint32)
            likely, whole = sample_similarity(own, [members[k] for k in near])
            near = near[likely >= np.where(whole, WHOLE_SCREEN, SAMPLE_SCREEN)]
            a_out.append(np.full(len(near), left["rep"][i], np.int64))
            b_out.append(right["rep"][near].astype(np.int64))
        return {"a": np.concatenate(a_out), "b": np.concatenate(b_out)}

    return grid_apply(side, side, kernel, "a long, b long", keys=["key"], left_rows=512, right_rows=512).distinct()


def near_duplicates(docs: DataFrame, identity: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row.

    With ``identity`` also ``text_key`` (hash of the text) and ``first``: true for one pair of id and text of each
    component, and for all rows that are in none. Ids need not be unique for that.
    """
    rows = store(sketches(docs))
    found = rows.where("n_shingles > 0")
    # a null id cannot lead a class; its rows are their own component
    leaders = found.where("doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key")).alias("_l"))
    leaders = leaders.select("d1", "d2", F.col("_l.doc_id").alias("lead_id"), F.col("_l.text_key").alias("lead_key"))
    # an id may lead several classes, so their names are places; these are in the order of ids
    named = with_position(leaders, ["lead_id", "lead_key", "d1", "d2"], name="rep")
    classes = store(
        found.join(named, ["d1", "d2"])
        .where("doc_id = lead_id and text_key = lead_key")
        .dropDuplicates(["rep"])
        .select("rep", "d1", "d2", "lead_id", "lead_key", "n_shingles", "sketch")
    )
    bands = _bands(classes)
    meetings = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = store(bands.join(meetings, "key"))
    # the original of a group of copies meets more of them than they meet each other
    known = met.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("known"))
    busiest = F.max(F.struct(F.col("known"), (-F.col("rep")).alias("least")))["least"]
    centers = met.join(known, "rep").groupBy("key").agg((-busiest).alias("center"))
    members = store(met.join(centers, "key"))
    # the only shuffle of texts: those that meet another one are stored beside their class
    texts = store(
        docs.select(F.col("doc_id").cast("long").alias("lead_id"), F.xxhash64("text").alias("lead_key"), "text")
        .join(
            classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "lead_id", "lead_key"),
            ["lead_id", "lead_key"],
        )
        .select("rep", "text")
    )
    pairs = store(
        members.where("rep <> center")
        .select(F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b"))
        .distinct()
    )
    links = store(_confirmed(_screened(pairs, classes), texts))
    labels = store(components(links))
    placed = members.where("n > 2").join(labels, F.col("rep") == F.col("node"), "left")
    placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    crowded = store(placed.join(mixed.select("key"), "key", "left_semi"))
    further = _across(crowded, classes, texts).join(pairs, ["a", "b"], "left_anti")
    more = store(_confirmed(further, texts))
    if not more.isEmpty():
        labels = store(components(links.unionByName(more)))
    of_class = (
        classes.select("rep", "d1", "d2")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select("d1", "d2", F.coalesce("component", "rep").alias("component"))
        .join(
            classes.select(
                F.col("rep").alias("component"), F.col("lead_id").alias("component_id"), F.col("lead_key").alias("component_key")
            ),
            "component",
        )
        .drop("component")
    )
    linked = found.drop("sketch").join(of_class, ["d1", "d2"], "left")
    alone = rows.where("n_shingles = 0").drop("sketch")
    alone = alone.withColumn("component_id", F.col("doc_id")).withColumn("component_key", F.col("text_key"))
    own = F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True))
    first = own & F.coalesce((F.col("component_key") == F.col("text_key")) | F.col("doc_id").isNull(), F.lit(True))
    return linked.unionByName(alone).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        own.alias("kept"),
        *(["text_key", first.alias("first")] if identity else []),
    )
