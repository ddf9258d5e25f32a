"""Near duplicates by word n-grams: an exact Jaccard self-join with parity sketches.

A document's n-grams toggle bits of a wide sketch, so the bits in which two
sketches differ are at most as many as the n-grams in which the sets do.  By
size, documents fall into bands; within a band's reach two similar sets differ
in at most t n-grams.  The sketch is cut into more than t parts: sets that
differ in t n-grams agree in all other parts.  Parts are put in one order for
all documents, very common patterns last and those with most bits first, and
each document hands out its first t + 1: two similar documents then share one
of these (a prefix of equal sets of parts, by the pigeonhole principle).
Documents that share a part are candidates and are verified with their whole
texts, word by word.

Equal sets are one class from the start: n-grams have keyed 64-bit hashes, and a
set two 64-bit sums of these, so that for different sets to be taken for one two
given n-grams would have to meet by chance.  Few documents on a part are paired
with each other.  Many are paired with one of them, the part's lead, which mostly
joins them; a very common pattern has an agreed lead, so that what hands it out
is paired in place and needs no meeting.  What is left apart among the followers
of a lead is compared with them block by block by dense sketches, whose Hamming
distance bounds the difference from below.  Small sets are decided there by their
hashes, and a block hands out no more links than join its components; large ones
are handed out as candidates.  Both are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.llm import lookup
from graphband.llm.components import components, extend
from graphband.llm.text import PIECE, U64, Words, encoded, mix64, pieces, slices
from graphband.session import discard, materialise, ship_package

SIZE, PERCENT = 5, 80
CROWD = 8  # documents on a part; above this they are paired with one of them
CHUNK = 512  # documents of a crowd that are compared with as many others at once
LIGHT = 256  # n-grams of a set that goes along with its dense sketch, so that a pair is decided where it is compared
FEW = 8  # candidates that a document hands out of a block at once
PARTS = 64  # at least; so many that small sets do not leave most parts empty
SKETCH_BITS = 4096
SEEN = 2_000_000  # classes that a task remembers having handed out
COUNTED = 2_000_000  # patterns that a task counts at once: the more, the better are leads chosen
BESIDE = 1_000_000  # the same where tasks share executors with other stages' workers
SHARE = 1 << 18  # patterns that are more than this part of all n-grams are very common: at most twice as many, as a set hands out two rows of parts at most
LEAST = 64  # and that so many classes hold


def difference(a: int, b: int, percent: int) -> int:
    """The most n-grams in which similar sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def parts(band: int, percent: int) -> int:
    """Into how many parts the sketches of a band's reach are cut: a third more than may differ."""
    top = (2 << band) - 1
    return max(PARTS, difference(top, top * 100 // percent, percent) * 4 // 3 + 2)


def shingle_sets(texts: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; A-Z count as a-z."""
    for i, j in slices(texts, 1 << 21):
        if j == i + 1 and len(texts[i]) > PIECE:
            yield np.unique(np.concatenate([Words([p.lower()], seed).shingles(0, size) for p, _ in pieces(texts[i], size - 1)]))
            continue
        words = Words([t.lower() for t in texts[i:j]], seed)
        for k in range(j - i):
            yield np.unique(words.shingles(k, size))


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit numbers of a set, as signed ones."""
    if not len(shingles):
        return 0, 0
    a = mix64(shingles + U64(0x632BE59BD9B4E019)).sum(dtype=U64)
    b = mix64(shingles ^ U64(0x2545F4914F6CDD1D)).sum(dtype=U64)
    two = mix64(np.array([a, b], U64) + U64(len(shingles))).view(np.int64)
    return int(two[0]), int(two[1])


def sketch_parts(shingles: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each band in reach: the parts' patterns as 64-bit keys, the n-grams in each part, and how many to hand out.

    None where only an equal set is similar, which is the same class.
    """
    n = len(shingles)
    home = max(n, 1).bit_length() - 1
    reach = [(home, n * 100 // percent)]
    if -(-n * percent // 100) < 1 << home:  # a similar set may be in the band below
        reach.append((home - 1, (1 << home) - 1))
    if not n or n * 100 // percent == n and -(-n * percent // 100) == n:
        return []
    spot = mix64(shingles ^ U64(0x8EBC6AF09C88C6E3))
    code = mix64(spot)
    out = []
    for band, other in reach:
        p = parts(band, percent)
        part = ((spot >> U64(32)) * U64(p) >> U64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        pattern, bits = np.zeros(p, U64), np.zeros(p, np.int64)
        pattern[held] = np.bitwise_xor.reduceat(code[order], first)
        bits[held] = np.diff(np.append(first, n))
        key = mix64(pattern ^ mix64(np.arange(p).astype(U64) + U64(band << 40)))
        out.append((key, bits, difference(n, other, percent) + 1))
    return out


NONE = np.empty(0, U64)


def sketch_keys(shingles: np.ndarray, percent: int, common: np.ndarray = NONE) -> np.ndarray:
    """The parts that a set hands out, as 64-bit keys; ``common`` (sorted) come last."""
    out = [NONE]
    for key, bits, n in sketch_parts(shingles, percent):
        late = np.isin(key, common) if len(common) else np.zeros(len(key), bool)
        out.append(key[np.lexsort((key, -bits, late))[:n]])
    return np.concatenate(out)


def dense_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the n-grams on each of SKETCH_BITS bits."""
    at = (mix64(shingles) % U64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram numbers of each text, which are equal for equal words alone; A-Z count as a-z."""
    words = [t.lower().split() for t in texts]
    number: dict[bytes, int] = {}
    short: dict[tuple[bytes, ...], int] = {}
    at = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    bits = max(len(number) - 1, 1).bit_length()
    if bits * size <= 62:  # few words: their numbers side by side
        n = max(len(at) - size + 1, 0)
        rank = at[:n]
        for k in range(1, size):
            rank = rank << bits | at[k : n + k]
    else:
        rank = _ranks(at, size)
    first, out = 0, []
    for ws in words:
        n = len(ws)
        if n > size:
            out.append(np.unique(rank[first : first + n - size + 1]))
        else:  # numbers of whole texts are negative
            out.append(np.array([~short.setdefault(tuple(ws), len(short))] if n else [], np.int64) if n < size else np.unique(rank[first : first + 1]))
        first += n
    return out


def _ranks(at: np.ndarray, size: int) -> np.ndarray:
    """A number of each run of ``size`` numbers, by its first place; equal for equal runs alone."""
    rank, have = at, 1

    def both(step: int) -> np.ndarray:
        return np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1] if len(rank) > step else rank[:0]

    while 2 * have <= size and len(rank):
        rank, have = both(have), 2 * have
    return both(size - have) if have < size and len(rank) else rank


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _signatures(docs: DataFrame, size: int, percent: int, seed: int, roll: lookup.Roll | None = None, at_once: int = COUNTED) -> DataFrame:
    """n, c, c2, doc_id, t, chunk of each row; and as n = -1 partial counts of patterns: t classes hold pattern c, and c2 has most such patterns of them, doc_id in number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        counted = 0

        def common() -> pd.DataFrame:
            key = np.concatenate([k for k, _ in held]).view(np.int64)
            c = np.repeat(np.array([x for _, x in held], np.int64), [len(k) for k, _ in held])
            held.clear()
            by = np.argsort(key, kind="stable")
            key, c = key[by], c[by]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            much = (n * SHARE >= min(len(key), at_once)) & (n > 1)
            often = np.repeat(much, n)
            key, c = key[often], c[often]
            # A pattern's lead is the class with most common patterns: copies of one text then have few leads.
            _, own, total = np.unique(c, return_inverse=True, return_counts=True)
            score = total[own]
            by = np.lexsort((c, score, key))
            last = np.cumsum(n[much]) - 1
            return pd.DataFrame({"n": -1, "c": key[by][last], "c2": c[by][last], "doc_id": score[by][last], "t": n[much], "chunk": lookup.chunk()}).astype({"doc_id": "Int64"})

        here = roll.here() if roll else None
        for b in batches:
            if here:
                here.see(b["mark"].to_numpy())
            rows = []
            for s in shingle_sets(encoded(b["text"]), size, seed):
                c, c2 = class_of(s)
                rows.append((len(s), c, c2))
                if len(s) and c not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    for key, bits, _ in sketch_parts(s, percent):
                        held.append((key[bits > 0], c))
                        counted += len(held[-1][0])
                    if counted >= at_once:
                        counted = 0
                        yield common()
            out = pd.DataFrame(rows, columns=["n", "c", "c2"], dtype="int64")
            yield out.assign(doc_id=b["doc_id"].astype("Int64").array, t=b["t"].array, chunk=lookup.chunk())
        if here:
            here.leave()
        if held:
            yield common()

    return docs.mapInPandas(run, "n long, c long, c2 long, doc_id long, t long, chunk int")


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Very common patterns, sorted, and the lead of each: at most 2 * SHARE, 8 MB."""
    total = rows.where("n > 0").agg(F.sum("n")).first()[0] or 0
    counts = rows.where("n = -1").groupBy("c").agg(F.sum("t").alias("n"), F.max_by("c2", F.struct("doc_id", "c2")).alias("lead"))
    found = counts.where(F.col("n") >= max(LEAST, total / SHARE)).select("c", "lead").toPandas()
    key, lead = found["c"].to_numpy(np.int64).view(U64), found["lead"].to_numpy(np.int64)
    by = np.argsort(key)
    return key[by], lead[by]


def _keys(docs: DataFrame, size: int, percent: int, seed: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, c, lead: what each class hands out, with the lead of a very common pattern; a task hands out a class once.

    With a lead, the key is the class itself: such rows have no one to meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, leads = shared.value
        seen: set[int] = set()
        for b in batches:
            keys, classes = [], []
            for s in shingle_sets(encoded(b["text"]), size, seed):
                c = class_of(s)[0]
                if len(s) and c not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    keys.append(sketch_keys(s, percent, common))
                    classes.append(np.full(len(keys[-1]), c, np.int64))
            if keys:
                key, c = np.concatenate(keys), np.concatenate(classes)
                at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                led = common[at] == key if len(common) else np.zeros(len(key), bool)
                lead = pd.Series(leads[at] if len(common) else c, dtype="Int64").mask(~led)
                yield pd.DataFrame({"key": np.where(led, c, key.view(np.int64)), "c": c, "lead": lead})

    return docs.mapInPandas(run, "key long, c long, lead long")


def _pairs(keys: DataFrame, crowd: int) -> DataFrame:
    """a, b (a < b), shared, led_by_a, led_by_b: candidates of rows sorted by key, one run of equal keys after another, in bounded memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = c = np.empty(0, np.int64)
        open_key = open_first = None  # of a run that went on beyond a batch and was a crowd already

        def table(lead: np.ndarray, c: np.ndarray, led: np.ndarray) -> pd.DataFrame:
            ok = lead != c
            lead, c, led = lead[ok], c[ok], led[ok]
            frame = pd.DataFrame({"a": np.minimum(lead, c), "b": np.maximum(lead, c), "led_by_a": led & (lead < c), "led_by_b": led & (lead > c)})
            return frame.groupby(["a", "b"], as_index=False).agg(shared=("led_by_a", "size"), led_by_a=("led_by_a", "max"), led_by_b=("led_by_b", "max"))

        def pairs(key: np.ndarray, c: np.ndarray) -> pd.DataFrame:
            found = [(c[:0], c[:0], False)]
            if len(key):
                new = np.append(True, key[1:] != key[:-1])
                first = np.flatnonzero(new)
                length = np.diff(np.append(first, len(key)))
                small = np.repeat(length <= crowd, length)
                run_of = np.cumsum(new)
                for d in range(1, crowd):
                    same = (run_of[d:] == run_of[:-d]) & small[d:]
                    found.append((c[:-d][same], c[d:][same], False))
                lead = np.repeat(c[first], length)
                many = ~small & ~new
                found.append((lead[many], c[many], True))
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            return table(a, b, np.repeat([f[2] for f in found], [len(f[0]) for f in found]))

        for batch in batches:
            led = batch["lead"].notna().to_numpy()
            if led.any():
                yield table(batch["lead"][led].to_numpy(np.int64), batch["c"].to_numpy()[led], np.ones(int(led.sum()), bool))
            key = np.concatenate([key, batch["key"].to_numpy()[~led]])
            c = np.concatenate([c, batch["c"].to_numpy()[~led]])
            if open_key is not None:
                n = int(np.searchsorted(key, open_key, side="right"))
                if n:
                    yield table(np.full(n, open_first), c[:n], np.ones(n, bool))
                    key, c = key[n:], c[n:]
                if len(key):
                    open_key = None
            if not len(key):
                continue
            again = np.append(False, (key[1:] == key[:-1]) & (c[1:] == c[:-1]))
            key, c = key[~again], c[~again]
            tail = int(np.searchsorted(key, key[-1]))
            if len(key) - tail > 1024:
                yield pairs(key, c)
                open_key, open_first = key[-1], c[tail]
                key = c = np.empty(0, np.int64)
            else:
                yield pairs(key[:tail], c[:tail])
                key, c = key[tail:], c[tail:]
        yield pairs(key, c)
        lookup.release()

    ordered = keys.repartition("key").sortWithinPartitions("key", "c")
    found = ordered.mapInPandas(run, "a long, b long, shared long, led_by_a boolean, led_by_b boolean")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("led_by_a").alias("led_by_a"), F.max("led_by_b").alias("led_by_b"))


def _texts(docs: DataFrame, rows: DataFrame, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """c, text: one text for each wanted class, from the first chunk that has it."""
    place = rows.where("n > 0").groupBy("c").agg(F.min("chunk").alias("chunk")).join(wanted, "c", "left_semi")
    folder = lookup.publish(place.select("chunk", "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = set(lookup.mine(folder, "c")[0].tolist())
        for b in batches:
            if not left:
                continue
            texts, out = encoded(b["text"]), []
            for text, s in zip(texts, shingle_sets(texts, size, seed), strict=True):
                c = class_of(s)[0]
                if len(s) and c in left:
                    left.remove(c)
                    out.append((c, text))
            yield pd.DataFrame(out, columns=["c", "text"]).astype({"c": "int64"})
        lookup.check(not left)
        lookup.release()

    return materialise(docs.mapInPandas(run, "c long, text binary"))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: by hashes, then by the words themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = np.zeros(len(b), bool)
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                texts = [bytes(t) for p in zip(part["ta"], part["tb"], strict=True) for t in p]
                sets = shingle_sets(texts, size, seed)
                near = [k for k, (x, y) in enumerate(zip(sets, sets, strict=True)) if similar(x, y, percent)]
                for k in near:
                    good[i + k] = similar(*exact_sets(texts[2 * k : 2 * k + 2], size), percent)
            yield b.loc[good, ["a", "b"]]
        lookup.release()

    first = pairs.select("a", "b").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
    return first.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").mapInPandas(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that no links join so far."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(end), F.col("comp").alias(f"comp_{end}")), end, "left")
    return pairs.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def _moved(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``_crowd_pairs`` with the components of now, without what these join."""
    for end in ("joined", "other"):
        found = found.join(labels.select(F.col("id").alias(end), F.col("comp").alias("now")), end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
    return materialise(found.where("joined <> other OR far = -2"))


def _sketches(followers: DataFrame, texts: DataFrame, size: int, seed: int) -> DataFrame:
    """c, n, sketch, own of the followers' classes; ``own`` are halves of the hashes of a set of LIGHT n-grams at most."""
    light = LIGHT

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = list(shingle_sets([bytes(t) for t in b["text"]], size, seed))
            own = [s.astype(np.uint32).tobytes() if len(s) <= light else None for s in sets]
            yield pd.DataFrame({"c": b["c"], "n": [len(s) for s in sets], "sketch": [dense_sketch(s) for s in sets], "own": own})

    return materialise(texts.join(followers.select("c").distinct(), "c", "left_semi").mapInPandas(sketch, "c long, n long, sketch binary, own binary"))


def _forest(pairs: list[tuple[np.ndarray, int, np.ndarray]], ends: tuple[pd.DataFrame, pd.DataFrame], percent: int) -> list[tuple]:
    """joined, other, far, a, b, sure of the nearest similar pairs that join what is apart; of pairs (distances, left row, right rows)."""
    far, x, y = (np.concatenate(v) for v in zip(*((f, np.full(len(f), i), at) for f, i, at in pairs), strict=True))
    sets = [[np.frombuffer(o, np.uint32) if o is not None else None for o in e["own"]] for e in ends]
    comp, c = ([e[k].tolist() for e in ends] for k in ("joined", "c"))
    root: dict[int, int] = {}

    def find(j: int) -> int:
        while (up := root.get(j, j)) != j:
            root[j] = j = root.get(up, up)
        return j

    out, by = [], np.argsort(far, kind="stable")
    for f, i, k in zip(far[by].tolist(), x[by].tolist(), y[by].tolist(), strict=True):
        j, other = find(comp[0][i]), find(comp[1][k])
        if j == other:
            continue
        size, union = len(sets[0][i]) + len(sets[1][k]), len(np.unique(np.concatenate([sets[0][i], sets[1][k]])))
        if 100 * (size - union) >= percent * union:  # halves that meet make a union smaller, so no similar pair is missed
            root[j] = other
            out.append((comp[0][i], comp[1][k], f, min(c[0][i], c[1][k]), max(c[0][i], c[1][k]), True))
    return out


def _crowd_pairs(followers: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, few: int | None, among: DataFrame | None = None) -> DataFrame:
    """joined, other, far, a, b, sure: pairs among the followers of a lead that are still apart and are similar by their hashes (sure) or may be, by dense sketches.

    Of a lead's followers most are joined; only those that are not in the
    largest component are compared, with each other and with the others.  Of small
    sets a block hands out similar pairs, and those alone that join its components.
    With ``few``, a larger one hands out its nearest ones of a block alone; what it leaves out
    is told by component (far = -1), or in sum (-2) where these are more than 8 * ``few``.
    Only components in ``among`` (id) count, where that is given.
    """
    member = followers.join(labels.select(F.col("id").alias("c"), "comp"), "c", "left")
    member = member.select("lead", "c", F.coalesce("comp", "c").alias("joined"))
    member = materialise(member if among is None else member.join(among.withColumnRenamed("id", "joined"), "joined", "left_semi"))
    joined = member.groupBy("lead", "joined").agg(F.count(F.lit(1)).alias("n"))
    sizes = joined.groupBy("lead").agg(F.sum("n").alias("all"), F.max(F.struct("n", "joined")).alias("most"))
    sizes = sizes.where(F.col("all") > F.col("most.n")).select("lead", F.col("most.joined").alias("most"), F.ceil(F.col("all") / CHUNK).cast("int").alias("chunks"), F.ceil((F.col("all") - F.col("most.n")) / CHUNK).cast("int").alias("odd_chunks"))
    sizes = materialise(sizes)
    rows = member.join(sizes, "lead").join(sketches, "c")
    spot = F.xxhash64("c")
    odd = rows.where("joined <> most").withColumn("side", F.lit(0)).withColumn("x", F.pmod(spot, "odd_chunks").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    all_ = rows.withColumn("side", F.lit(1)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("odd_chunks") - 1))).withColumn("y", F.pmod(spot, "chunks").cast("int"))

    def compare(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        left, right = (b[b["side"] == k].reset_index(drop=True) for k in (0, 1))
        found, decided = [], []
        light = right["own"].notna().to_numpy()
        bits = np.frombuffer(b"".join(right["sketch"]), np.uint64).reshape(len(right), -1)
        n, joined, c, most = (right[k].to_numpy() for k in ("n", "joined", "c", "most"))
        for i, r in enumerate(left.itertuples()):
            far = np.bitwise_count(bits ^ np.frombuffer(r.sketch, np.uint64)).sum(axis=1)
            good = (far <= (r.n + n) * (100 - percent) // (100 + percent)) & (joined != r.joined) & (100 * np.minimum(n, r.n) >= percent * np.maximum(n, r.n))
            once = good & ((joined == most) | (c > r.c))
            if r.own is not None:
                at = np.flatnonzero(once & light)
                decided.append((far[at], i, at))
                good, once = good & ~light, once & ~light
            at = np.flatnonzero(good if few else once)
            at = at[np.argsort(far[at], kind="stable")]
            over = np.unique(joined[at[few:]]).tolist() if few else []
            found += [(r.joined, j, f, min(r.c, x), max(r.c, x), False) for j, x, f in zip(*(v[at[:few]].tolist() for v in (joined, c, far)), strict=True)]
            found += [(r.joined, j, -1, 0, 0, False) for j in over] if not few or len(over) <= 8 * few else [(r.joined, r.joined, -2, 0, 0, False)]
        if decided:
            found += _forest(decided, (left, right), percent)
        return pd.DataFrame(found, columns=["joined", "other", "far", "a", "b", "sure"]).astype(dict.fromkeys(("joined", "other", "far", "a", "b"), "int64") | {"sure": bool})

    return odd.unionByName(all_).groupBy("lead", "x", "y").applyInPandas(compare, "joined long, other long, far long, a long, b long, sure boolean")


def _classify(docs: DataFrame, roll: lookup.Roll, size: int, percent: int, at_once: int = COUNTED) -> DataFrame:
    """doc_id, t, chunk, n, component_id of every row of docs (doc_id, text, t, more)."""
    for seed in range(8):  # a number that two different sets share calls for another seed
        seen = materialise(_signatures(docs, size, percent, seed, roll, at_once))
        rows = seen.where("n >= 0")
        classes = materialise(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("named"), (F.min("c2") != F.max("c2")).alias("clash")))
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError("different sets share a number under each of eight seeds")
    labels = _joined(docs, seen, size, percent, seed)
    named = classes.join(labels.withColumnRenamed("id", "c"), "c", "left").select("c", "named", F.coalesce("comp", "c").alias("comp"))
    best = named.groupBy("comp").agg(F.min("named").alias("component_id"))
    ids = materialise(named.join(best, "comp").select("c", "component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(ids, "c", "left").select("doc_id", "t", "chunk", "n", component.alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and t, a hash of its text that tells rows with one id apart.

    Documents are linked when ``100 * intersection >= percent * union`` of
    their sets of ``size``-word n-grams; a text with fewer words has its whole
    sequence as the only one.  Null and empty texts have none and are their own
    component, as is their id.  Rows with equal ids count as copies of one
    document; a null id never names a component that has others.  Other columns
    are not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    docs = lookup.steady(docs)
    found = _classify(_read(docs, id_col, text_col), lookup.roll_call(docs, id_col), size, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "t")


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t"), lookup.mark(docs[id_col]))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns: one document of each group.

    Rows that repeat an id and its text stay or go together; a null id stays
    where its component has no other.  No text is shuffled.
    """
    ship_package(docs.sparkSession)
    docs = lookup.steady(docs)
    roll = lookup.roll_call(docs, id_col)
    found = _classify(_read(docs, id_col, text_col), roll, size, percent, BESIDE)
    kept = found.where("doc_id <=> component_id").select("chunk", F.xxhash64("doc_id").alias("a"), F.col("t").alias("b")).distinct()
    return lookup.keep(docs, roll, kept, id_col, text_col)


def _joined(docs: DataFrame, seen: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """id, comp of the classes that verified links join."""
    candidates = materialise(_pairs(_keys(docs, size, percent, seed, _common(seen)), CROWD))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = _texts(docs, seen, wanted, size, seed)
    check = lambda pairs: materialise(_verified(pairs, texts, size, percent, seed))

    # First each class with the one that shares most parts with it, which leaves few others apart.
    best = materialise(candidates.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("x")).select("x.a", "b"))
    labels = components(check(best))
    labels = extend(labels, check(_apart(candidates.join(best, ["a", "b"], "left_anti"), labels)))
    a, b = candidates.where("led_by_a"), candidates.where("led_by_b")
    followers = a.select(F.col("a").alias("lead"), F.col("b").alias("c")).unionAll(b.select(F.col("b").alias("lead"), F.col("a").alias("c")))
    if not followers.isEmpty():
        followers = materialise(followers.unionAll(followers.select("lead", F.col("lead").alias("c"))).distinct())
        sketches, few, among = _sketches(followers, texts, size, seed), FEW, None
        by_hash = sketches
        while True:  # what a pass leaves out and is still apart comes again, and all of it where few were joined
            found = materialise(_crowd_pairs(followers, labels, by_hash, percent, few, among))
            links = tries = 0
            while True:  # components join their nearest ones, round by round; when few do, all pairs that are left are tried
                best = materialise(found.where("far >= 0").groupBy("joined").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
                new = check(best)
                labels, n, of = extend(labels, new), new.count(), best.count()
                found, links, tries = _moved(found, labels), links + n, tries + of
                if 4 * n <= of:
                    break
            new = check(found.where("far >= 0").select("a", "b").distinct())
            labels = extend(labels, new)
            found = _moved(found.where("far < 0 OR sure"), labels)
            if found.isEmpty():
                break
            if not found.where("sure").isEmpty():  # hashes met by chance: what these pairs stood for is compared again without
                by_hash = sketches.withColumn("own", F.lit(None).cast("binary"))
            few = FEW if 4 * (links + new.count()) > tries else None
            among = None if not found.where("far = -2").isEmpty() else materialise(found.select(F.explode(F.array("joined", "other")).alias("id")).distinct())
        discard(followers, sketches)
    discard(texts, candidates)
    return labels
