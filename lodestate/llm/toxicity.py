"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reporting verb, or other. Five weighted transducers (insult,
threat, target, negation, reported speech) are composed into machines that read each clause that holds an insult or a
threat. Their arcs carry features (a match, aimed at somebody, negated, reported), whose weights add up along the
path: that is the clause's score, and a final weight comes on top where a match is left that nothing weakens. A
document's score is the logistic function of its best clause's score and of how many others score as well, so isolated
neutral words never score. The insult lexicon grows from the training labels (words and word beginnings that toxic
rows have and clean rows don't); the weights are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import bounded_arrow, blocks, mix, span_hashes, stored, text_view, word_spans

#: At most about so many toxic rows, and CLEAN_RATIO times as many clean ones, are learned from: those of the smallest hash of their key.
TRAIN_ROWS, CLEAN_RATIO = 5000, 4
#: A learned lexicon entry has at most this share of its rows among clean ones, and EVIDENCE nats against chance.
CLEAN_SHARE, EVIDENCE = 0.01, 12.0
#: Word beginnings of these many bytes can be lexicon entries.
PREFIXES = (4, 5, 6, 7, 8)
#: How many words a negation or a target reaches.
REACH = 4

# The grammar's seed words.
SEED = {
    "I": "idiot idiots moron morons stupid fool fools loser losers scum trash pathetic worthless disgusting clown clowns jerk dumb crétin imbécile idiote connard dummkopf trottel abschaum idiota imbécil estúpido estúpida basura",
    "T": "kill hurt destroy murder strangle beat smash töten verletzen zerstören tuer frapper détruire matar golpear destruir",
    "G": "you your yours he she him her they them their these those du dich dir ihr euch sie tu toi te vous vos elle ils elles tú ti usted ustedes ellos ellas",
    "N": "not no never none isn't aren't don't won't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna",
    "R": "said says say wrote writes quoted reported claims claimed called sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió afirma",
}
#: What arcs can add to a clause's path.
FEATURES = ("insult", "threat", "aimed insult", "aimed threat", "negated insult", "negated threat", "reported insult", "reported threat")
#: A feature counts at most so often in one clause.
OFTEN = 3
#: Weights to begin with: of FEATURES, the final weight of a clause with a match that nothing weakens, of further clauses that
#: score (the logarithm of their number), and the bias; training moves them as far as labels tell.
PRIOR = np.array([3.0, 0.6, 0.5, 1.9, -2.5, -0.5, -2.2, -0.3, 1.5, 0.5, -2.0])

Arc = tuple[int, str, tuple[int, ...]]


class Transducer:
    """A weighted finite-state transducer: arcs[state][symbol] = (next state, written symbol, features); a missing arc copies and goes to state 0."""

    def __init__(self, arcs: dict[int, dict[str, Arc]]) -> None:
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> Arc:
        return self.arcs[state].get(symbol, (0, symbol, ()))

    def compose(self, then: Transducer) -> Transducer:
        """The machine that feeds what this one writes to the other; the features of both arcs add up."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = pair = todo.pop()
            arcs[number[pair]] = own = {}
            for symbol in SYMBOLS:
                a2, mid, one = self.step(a, symbol)
                b2, out, two = then.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                own[symbol] = number[a2, b2], out, one + two
        return Transducer(arcs)

    def read(self, clause: list[str]) -> tuple[list[str], list[int]]:
        """(what it writes, the features on the path)."""
        state, out, features = 0, [], []
        for symbol in clause:
            state, wrote, own = self.arcs[state][symbol]
            out.append(wrote)
            features += own
        return out, features


#: Read: classes of words (I insult, T threat, G target, N negation, R reporting verb, O other). Written: a insult, b aimed,
#: c negated, d reported; e to h the same of threats.
SYMBOLS = "ITGNROabcdefgh"


def _matching(read: str, write: str, feature: str) -> Transducer:
    """Words of a class become matches."""
    return Transducer({0: {read: (0, write, (FEATURES.index(feature),))}})


def _arcs(change: dict[str, tuple[str, str]], after: int) -> dict[str, Arc]:
    return {s: (after, out, (FEATURES.index(feature),)) for s, (out, feature) in change.items()}


def _reaching(trigger: str, change: dict[str, tuple[str, str]], reach: int) -> Transducer:
    """Within reach symbols after the trigger, matches are rewritten."""
    arcs: dict[int, dict[str, Arc]] = {}
    for state in range(reach + 1):
        after = max(0, state - 1)
        arcs[state] = {s: (after, s, ()) for s in SYMBOLS} | (_arcs(change, after) if state else {})
        arcs[state][trigger] = reach, trigger, ()
    return Transducer(arcs)


def _to_the_end(trigger: str, change: dict[str, tuple[str, str]]) -> Transducer:
    """From the trigger to the end of the clause, matches are rewritten."""
    off, on = ({s: (state, s, ()) for s in SYMBOLS} for state in (0, 1))
    on |= _arcs(change, 1)
    off[trigger] = on[trigger] = 1, trigger, ()
    return Transducer({0: off, 1: on})


@dataclass
class Grammar:
    """Two machines: ``after`` reads a clause from its end, finds the matches and aims those that a target follows;
    ``machine`` reads what that wrote from its start: targets before the match, negation, then reported speech.
    """

    after: Transducer
    machine: Transducer

    def read(self, clause: list[str]) -> tuple[list[str], np.ndarray]:
        """(the clause's symbols as they end up, its vector: FEATURES, and whether a match is left that nothing weakens)."""
        marked, first = self.after.read(clause[::-1])
        out, second = self.machine.read(marked[::-1])
        vector = np.zeros(len(FEATURES) + 1)
        vector[:-1] = np.minimum(np.bincount(first + second, minlength=len(FEATURES)), OFTEN)
        vector[-1] = any(x in "abf" for x in out)
        return out, vector


def grammar() -> Grammar:
    insult, threat = _matching("I", "a", "insult"), _matching("T", "e", "threat")
    target = _reaching("G", {"a": ("b", "aimed insult"), "e": ("f", "aimed threat")}, REACH)
    weak = lambda i, t, kind: {"a": (i, f"{kind} insult"), "b": (i, f"{kind} insult"), "e": (t, f"{kind} threat"), "f": (t, f"{kind} threat")}
    negation = _reaching("N", weak("c", "g", "negated"), REACH)
    reported = _to_the_end("R", weak("d", "h", "reported"))
    return Grammar(insult.compose(threat).compose(target), target.compose(negation).compose(reported))


_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = _LETTER[0x27] = True
_END = np.zeros(256, bool)
_END[[0x0A, 0x21, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F]] = True


@dataclass
class Words:
    hashes: np.ndarray
    rows: np.ndarray
    clauses: np.ndarray
    prefixes: list[np.ndarray]  # for each of PREFIXES; 0 where the word is shorter


def _read(column: pa.Array) -> Words:
    """Words of lower-cased texts with their clause, and hashes of their beginnings."""
    lowered = pa.array([(x or "").lower().replace("’", "'") for x in column.to_pylist()], pa.string())
    raw, offsets = text_view(lowered)
    starts, ends, rows = word_spans(_LETTER[raw], offsets)
    from ._batches import prefix_sums

    sums = prefix_sums(raw)
    ends_at = np.nonzero(_END[raw])[0]
    clauses = np.searchsorted(ends_at, starts) + rows  # a border between rows ends a clause as well
    prefixes = [np.where(ends - starts >= n, span_hashes(raw, starts, np.minimum(starts + n, len(raw)), sums) | np.uint64(1), np.uint64(0)) for n in PREFIXES]
    return Words(span_hashes(raw, starts, ends, sums) & ~np.uint64(1), rows, clauses, prefixes)


def _word_hash(word: str) -> np.uint64:
    return _read(pa.array([word])).hashes[0]


@dataclass
class Model:
    table: np.ndarray  # sorted hashes of words (even) and beginnings (odd)
    symbols: np.ndarray  # their symbols, as bytes
    weights: np.ndarray  # in the order of PRIOR

    @classmethod
    def seeded(cls, learned: np.ndarray) -> Model:
        known: dict[int, str] = {int(h): "I" for h in learned}
        for symbol, words in SEED.items():
            known |= {int(_word_hash(w)): symbol for w in words.split()}
        table = np.array(sorted(known), np.uint64)
        return cls(table, np.array([known[int(h)] for h in table], "S1"), PRIOR.copy())

    def symbol(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return np.where(self.table[at] == hashes, self.symbols[at], b"O")


def clauses(column: pa.Array, model: Model, rules: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """(row, vector) of every clause with a match in the texts."""
    words = _read(column)
    nothing = np.zeros(0, np.int64), np.zeros((0, len(FEATURES) + 1))
    if not len(words.hashes):
        return nothing
    symbols = model.symbol(words.hashes)
    for prefix in words.prefixes:
        symbols = np.where((symbols == b"O") & (model.symbol(prefix) == b"I"), b"I", symbols)
    strong = (symbols == b"I") | (symbols == b"T")
    if not strong.any():
        return nothing
    chosen = np.unique(words.clauses[strong])
    at = np.minimum(np.searchsorted(chosen, words.clauses), len(chosen) - 1)
    mine = np.nonzero(chosen[at] == words.clauses)[0]
    read = symbols[mine].astype("U1").tolist()
    first = np.nonzero(np.diff(words.clauses[mine], prepend=-1))[0].tolist()
    vectors = [rules.read(read[a:b])[1] for a, b in zip(first, [*first[1:], len(read)], strict=True)]
    return words.rows[mine[first]], np.array(vectors)


def _documents(rows: np.ndarray, vectors: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """n x len(PRIOR): for each document its best clause, the logarithm of the number of others that score, and 1."""
    out = np.zeros((n, len(PRIOR)))
    out[:, -1] = 1
    if len(rows):
        value = vectors @ weights[: vectors.shape[1]]
        order = np.lexsort((value, rows))
        last = np.nonzero(np.append(rows[order][1:] != rows[order][:-1], True))[0]
        best = order[last]
        out[rows[best], : vectors.shape[1]] = vectors[best]
        scoring = np.bincount(rows[value > 0], minlength=n)
        out[:, -2] = np.log1p(np.maximum(scoring - 1, 0))
        out[rows[best[value[best] <= 0]], : vectors.shape[1]] = 0  # no clause scores: as if there were no match
    return out


def _fit(rows: np.ndarray, vectors: np.ndarray, y: np.ndarray, strength: float = 0.3, rounds: int = 6) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards PRIOR; which clause stands for a document is chosen anew in each round."""
    w = PRIOR.copy()
    for _ in range(rounds):
        x = _documents(rows, vectors, len(y), w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - PRIOR))
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
    return w


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn lexicon and weights from docs with a label (0 or 1), about train_rows toxic ones and four times as many clean ones at most.

    labels may hold repeated keys (the largest label counts) and null labels (left out). Near copies among the rows
    count once, so that a text copied many times doesn't put its words into the lexicon. Without labels of both classes
    the seed grammar and its prior weights stay. The sample (its size is bounded) is what gets broadcast to the scan.
    """
    bounded_arrow(docs.sparkSession)
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model.seeded(np.zeros(0, np.uint64))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, train_rows / sizes[1]))).otherwise(F.lit(min(1.0, CLEAN_RATIO * train_rows / sizes[0])))
    picked = one.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(picked), "key").select(F.col("key").cast("string").alias("key"), "text", "y")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = _read(block.column("text"))
            n = block.num_rows
            low = np.full((2, n), -1, np.int64)
            if len(words.hashes) > 2:
                three = words.hashes[:-2] * np.uint64(3) + words.hashes[1:-1] * np.uint64(5) + words.hashes[2:] * np.uint64(7)
                own = words.rows[:-2] == words.rows[2:]
                for i in (0, 1):
                    np.minimum.at(value := np.full(n, (1 << 63) - 1), words.rows[:-2][own], (mix(three[own] + np.uint64(i)) >> np.uint64(1)).astype(np.int64))
                    low[i] = np.where(value == (1 << 63) - 1, -1, value)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(low[0]), pa.array(low[1])], ["key", "text", "y", "m0", "m1"])

    # Short texts (sketch -1) are told apart by their text.
    own = lambda c: F.when(F.col(c) < 0, F.xxhash64("text")).otherwise(F.col(c))
    sample = rows.mapInArrow(sketch, "key string, text string, y int, m0 long, m1 long").withColumn("m0", own("m0")).withColumn("m1", own("m1"))
    for sketch_value in ("m0", "m1"):  # of near copies the smallest key stays, whatever order rows come in
        sample = sample.groupBy(sketch_value).agg(F.min(F.struct("key", "text", "y", *({"m0", "m1"} - {sketch_value}))).alias("r")).select("r.*", sketch_value)
    sample = stored(sample.select("text", "y"), "sample")

    def counted(rows: DataFrame, known=None) -> DataFrame:
        """(term, n): rows that each lexicon candidate is in; known: a broadcast sorted array of the terms that matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "text", 8 << 20):
                words = _read(block.column("text"))
                pairs = np.concatenate([np.stack([words.rows.astype(np.uint64), h], 1) for h in (words.hashes, *words.prefixes)])
                keep = pairs[:, 1] != 0
                if known is not None:
                    table = known.value
                    keep &= table[np.minimum(np.searchsorted(table, pairs[:, 1]), len(table) - 1)] == pairs[:, 1]
                term, n = np.unique(np.unique(pairs[keep], axis=0)[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

        return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model.seeded(np.zeros(0, np.uint64))
    if len(n) == 2:
        rate = n[1] / (n[0] + n[1])
        # a term needs so many toxic rows for its evidence, which bounds the candidates by the sample
        toxic = counted(sample.where("y = 1")).where(F.col("n") >= EVIDENCE / -np.log(rate)).toPandas().sort_values("term")
        terms = np.sort(toxic["term"].to_numpy(np.int64).view(np.uint64))
        if len(terms):
            clean = counted(sample.where("y = 0"), docs.sparkSession.sparkContext.broadcast(terms)).toPandas()
            both = toxic.merge(clean, on="term", how="left", suffixes=("", "_clean")).fillna(0)
            t, c = both["n"].to_numpy(float), both["n_clean"].to_numpy(float)
            evidence = t * np.log(t / ((t + c) * rate)) + np.where(c > 0, c * np.log(np.maximum(c, 1) / ((t + c) * (1 - rate))), 0)
            model = Model.seeded(both["term"].to_numpy(np.int64)[(c <= CLEAN_SHARE * (t + c)) & (evidence >= EVIDENCE)].view(np.uint64))
        handle = docs.sparkSession.sparkContext.broadcast(model)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = grammar()
            for block in blocks(batches, "text"):
                row, vectors = clauses(block.column("text"), handle.value, machine)
                bounds = np.searchsorted(row, np.arange(block.num_rows + 1))
                lists = [vectors[a:b].reshape(-1).tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.float64())), block.column("y")], ["vectors", "y"])

        found = sample.mapInArrow(read, "vectors array<double>, y int").toPandas()
        width = len(FEATURES) + 1
        counts = [len(v) // width for v in found["vectors"]]
        model.weights = _fit(np.repeat(np.arange(len(found)), counts), np.concatenate([np.zeros(0), *found["vectors"]]).reshape(-1, width), found["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of docs inside ``row``; ``matches`` (counts of FEATURES over all clauses) and ``score`` between 0 and 1 of the whole text.

    Null and empty texts have no match and get the score of a text without any; texts of any length are read whole.
    Equal texts score equally. Names of columns don't matter, as they stay inside ``row``.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for block in blocks(batches, "text"):
            row, vectors = clauses(block.column("text"), handle.value, machine)
            counts = np.zeros((block.num_rows, len(FEATURES)), np.int64)
            np.add.at(counts, row, vectors[:, :-1].astype(np.int64))
            value = 1 / (1 + np.exp(-np.clip(_documents(row, vectors, block.num_rows, handle.value.weights) @ handle.value.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(counts.tolist(), pa.list_(pa.int64())), pa.array(value)], ["row", "matches", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, matches array<bigint>, score double")
