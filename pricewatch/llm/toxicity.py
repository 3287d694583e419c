"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Lexicon. Words of labelled texts form a trie whose nodes carry document counts per label; a node is
a prefix of a word, or a whole word (its last letter followed by an end mark). A node becomes a term
when its log-likelihood ratio passes a bound corrected for the number of nodes tested and its log
odds are high. The strongest node of every path is taken, the deepest of equals, so a term is a
whole word where all its uses are that word, and a stem where it has many endings. Near copies
would count a text's chance words many times; of texts of one label whose runs of five words are
alike (a Jaccard similarity of 0.8 or more, compared whole) one therefore counts, and a term that is
not far beyond chance must explain texts that no stronger term explains.

Matching. The trie is intersected with the Levenshtein automaton (insert, delete, substitute,
transpose) of the text's word: a state is a set of (trie node, edits), and transitions are made
when first needed and kept, so a word costs one look-up per letter. Terms of 5 letters allow one
edit, of 9 letters two. Each term and number of edits has its own weight, learned from how often
such forms occur in clean texts; a form that is an ordinary word elsewhere weighs nothing.

Context. Around a hit, a window of words is read for quotation marks, words of reporting and words
of address. Their log odds come from labelled hits, smoothed by prior rates; quotation and report
lower the weight of a hit, to zero at the least.

The evidence of a text is the sum of its terms' weights, each term counted once, at its strongest.
The score is a logistic function of the evidence, fitted on the sample with each label weighted to
its share of all labels, so that weak terms which clean texts also hold count for little alone.
Labels are learned from a bounded sample (``toxic_rows`` and ``clean_rows``, chosen by a hash of
the id); every text is scored whole.

Null and empty texts score as texts without a hit. Null labels teach nothing; of repeated labels
each counts. Without labels of both kinds every score is 0. Repeated rows score alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.common import WordCache, bucket, release_memory, sliced, stored

END = "\x00"
#: Shortest and longest prefix (with the end mark) that can be a term.
SHORTEST, LONGEST = 4, 16
WINDOW = 5
#: Near copies: words of a shingle, similarity of their sets, bands of minimum hashes that find them.
SHINGLE, ALIKE, BANDS, BAND = 5, 0.8, 8, 2
_TOKEN = re.compile(r"\S+")
_PART = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

# Marks and words that the context window looks for.
QUOTES = "\"'“”„«»‘’‚‹›`"
REPORTING = frozenset(
    "said says say saying wrote writes written called calls quote quoted quotes quoting word words term"
    " phrase reported reports stated claimed termed so-called".split()
)
ADDRESS = frozenset("you your you're youre ur u yourself du dich dein tu te ton toi tú eres usted vous".split())
#: Prior rates of each context feature around hits: (in abuse, in quotation).
PRIOR_RATES = {"quoted": (0.002, 0.6), "reported": (0.05, 0.5), "addressed": (0.2, 0.05)}
PRIOR_HITS = 50


def words_of(token: str) -> list[str]:
    """Forms of a token to match: without its outer punctuation, and its parts if it has inner punctuation."""
    whole = _EDGE.sub("", token.lower())
    if not whole:
        return []
    parts = _PART.findall(whole)
    return [whole] if len(parts) < 2 else [whole, *parts]


def prefixes(text: str) -> set[str]:
    """Trie nodes of a text's words."""
    nodes = set()
    for word in {w for t in set(_TOKEN.findall(text)) for w in words_of(t)}:
        marked = word + END
        for n in range(SHORTEST, min(len(marked), LONGEST) + 1):
            nodes.add(marked[:n])
    return nodes


def _edits(length: int) -> int:
    return 2 if length >= 9 else 1 if length >= 5 else 0


#: States of the automaton and words of the cache (in each of two generations) that a task keeps.
MOST_STATES, CACHED_WORDS = 50_000, 100_000


class Automaton:
    """Levenshtein automata intersected with the trie of the terms, made deterministic as needed."""

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.stem: list[int] = [-1]
        self.whole: list[int] = [-1]
        self.allow: list[int] = [0]
        self.limit = [_edits(len(t.rstrip(END))) for t in terms]
        for number, term in enumerate(terms):
            node = 0
            self.allow[0] = max(self.allow[0], self.limit[number])
            for letter in term.rstrip(END):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.stem.append(-1)
                    self.whole.append(-1)
                    self.allow.append(0)
                node = self.children[node][letter]
                self.allow[node] = max(self.allow[node], self.limit[number])
            if term.endswith(END):
                self.whole[node] = number
            else:
                self.stem[node] = number
        self._forget()

    def _forget(self) -> None:
        """Start again without states: they are made as words need them."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple] = []  # stems completed on entering the state
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """Adds the items reached by leaving out letters of the term."""
        best: dict[tuple[int, str], int] = {}
        queue = list(items)
        while queue:
            node, edits, held = queue.pop()
            if edits > self.allow[node] or best.get((node, held), 99) <= edits:
                continue
            best[node, held] = edits
            if not held:
                queue.extend((child, edits + 1, "") for child in self.children[node].values())
        return frozenset((node, edits, held) for (node, held), edits in best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            self.found.append(tuple(
                (self.stem[node], edits) for node, edits, held in items
                if not held and self.stem[node] >= 0 and edits <= self.limit[self.stem[node]]
            ))
        return self.states[items]

    def _next(self, state: int, letter: str) -> int:
        items = set()
        for node, edits, held in self.sets[state]:
            if held:  # the second letter of a transposition
                if letter in self.children[node] and held in self.children[self.children[node][letter]]:
                    items.add((self.children[self.children[node][letter]][held], edits, ""))
                continue
            if letter in self.children[node]:
                items.add((self.children[node][letter], edits, ""))
            items.add((node, edits + 1, ""))
            items.update((child, edits + 1, "") for other, child in self.children[node].items() if other != letter)
            if any(letter in self.children[c] for c in self.children[node].values()):
                swapped = {n for n, c in self.children[node].items() if letter in self.children[c]}
                if swapped and edits + 1 <= self.allow[node]:
                    items.add((node, edits + 1, letter))
        # a held letter waits for the letter that should have come before it
        return self._state(self._closed(items))

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, fewest edits) of every term the word, or its beginning for a stem, is close to."""
        if len(self.sets) > MOST_STATES:
            self._forget()
        best: dict[int, int] = {}
        state = self.start
        for letter in word:
            following = self.moves[state].get(letter)
            if following is None:
                following = self.moves[state][letter] = self._next(state, letter)
            state = following
            for term, edits in self.found[state]:
                best[term] = min(edits, best.get(term, 99))
            if not self.sets[state]:
                break
        else:
            for node, edits, held in self.sets[state]:
                term = self.whole[node]
                if not held and term >= 0 and edits <= self.limit[term]:
                    best[term] = min(edits, best.get(term, 99))
        return tuple(sorted(best.items()))


def context_features(tokens: list[str], at: int) -> tuple[str, ...]:
    """Features of the window around a hit."""
    before, own, after = tokens[max(0, at - WINDOW) : at], tokens[at], tokens[at + 1 : at + 1 + WINDOW]
    found = []
    opened = own[0] in QUOTES or any(t[0] in QUOTES for t in before)
    closed = own.rstrip(".,;:!?)")[-1:] in tuple(QUOTES) or any(t.rstrip(".,;:!?)")[-1:] in tuple(QUOTES) for t in after)
    if opened and closed:
        found.append("quoted")
    around = {_EDGE.sub("", t.lower()) for t in (*before, *after)}
    if around & REPORTING:
        found.append("reported")
    if around & ADDRESS:
        found.append("addressed")
    return tuple(found)


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -math.inf  # no labels: every score is 0


class Matcher:
    """Hits of a text: (term, edits, context features)."""

    def __init__(self, terms: list[str]) -> None:
        automaton = Automaton(terms)

        def of_token(token: str) -> tuple:
            best: dict[int, int] = {}
            for word in words_of(token):
                for term, edits in automaton.match(word):
                    best[term] = min(edits, best.get(term, 99))
            return tuple(best.items())

        self.cache = WordCache(lambda tokens: map(of_token, tokens), words=CACHED_WORDS)

    def hits(self, text: str | None) -> list[tuple[int, int, tuple[str, ...]]]:
        tokens = _TOKEN.findall(text or "")
        distinct = set(tokens)
        found = self.cache.look_up(distinct)
        matched = {t for t in distinct if found[t]}
        if not matched:
            return []
        return [
            (term, edits, context_features(tokens, i))
            for i, token in enumerate(tokens) if token in matched
            for term, edits in found[token]
        ]


def _toxic_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in sliced(batches, "text"):
        for text in batch.column("text").to_pylist():
            counts.update(prefixes(text or ""))
    yield pa.RecordBatch.from_pydict({"node": list(counts), "docs": list(counts.values())})


def _clean_nodes(wanted: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update(wanted & prefixes(text or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["node", "docs"]
        )

    return run


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _likelihood_ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """G statistic of the two-by-two table of label and presence."""

    def part(seen: int, expected: float) -> float:
        return seen * math.log(seen / expected) if seen else 0.0

    n, seen = n_toxic + n_clean, toxic + clean
    return 2 * (
        part(toxic, n_toxic * seen / n) + part(clean, n_clean * seen / n)
        + part(n_toxic - toxic, n_toxic * (n - seen) / n) + part(n_clean - clean, n_clean * (n - seen) / n)
    )


def _significant(tried: int) -> float:
    return 2 * math.log(max(1, tried) / 0.05)


def fewest_documents(tried: int, n_toxic: int, n_clean: int) -> int:
    """Toxic documents that a node needs to be significant, were it in no clean one."""
    return next((t for t in range(1, n_toxic + 1) if _likelihood_ratio(t, 0, n_toxic, n_clean) >= _significant(tried)), n_toxic + 1)


def choose_terms(
    toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least_odds: float, tried: int
) -> list[str]:
    """Terms of the trie, strongest first; the bound allows for all nodes that were ``tried``."""
    bound = _significant(tried)
    strength = {}
    for node, t in toxic.items():
        if _log_odds(t, clean.get(node, 0), n_toxic, n_clean) >= least_odds:
            strength[node] = _likelihood_ratio(t, clean.get(node, 0), n_toxic, n_clean)
    chosen: list[str] = []
    covered: set[str] = set()  # chosen nodes and what stands above them
    for node in sorted(strength, key=lambda n: (-strength[n], -len(n), n)):
        if strength[node] < bound:
            break
        beginnings = {node[:n] for n in range(SHORTEST, len(node) + 1)}
        if node not in covered and not beginnings.intersection(chosen):
            chosen.append(node)
            covered |= beginnings
    return chosen


def _exact_batches(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in sliced(batches, "text"):
            hits = [sorted({t for t, e, _ in matcher.hits(x) if e == 0}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "terms"]
            )

    return run


def needed_terms(
    terms: list[str], toxic_texts: list[list[int]], clean_counts: Counter, n_toxic: int, n_clean: int
) -> list[str]:
    """Terms far beyond chance, and those that explain toxic texts which no stronger term explains.

    A chance word of a toxic text that was copied in parts passes the bound but always stands
    beside a true term.
    """
    bound = 2 * math.log(max(1, len(terms)) / 0.05)
    beyond = 20 * bound
    of_term: dict[int, set[int]] = {}
    for row, found in enumerate(toxic_texts):
        for term in found:
            of_term.setdefault(term, set()).add(row)
    explained: set[int] = set()
    kept = []
    for number, term in enumerate(terms):  # strongest first
        own, clean = of_term.get(number, set()), clean_counts[number]
        new = own - explained
        if (
            _likelihood_ratio(len(own), clean, n_toxic, n_clean) >= beyond
            or _likelihood_ratio(len(new), clean, n_toxic, n_clean) >= bound
        ) and _log_odds(len(own), clean, n_toxic, n_clean) > 0:
            kept.append(term)
            explained |= own
    return kept


def _hit_batches(terms: list[str]):
    """Counts of the sample: kind, key, toxic and clean documents (or hits, for the context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        counts: dict[str, list[int]] = {}
        for batch in sliced(batches, "text"):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                hits = matcher.hits(text)
                best: dict[int, int] = {}
                for term, edits, _ in hits:
                    best[term] = min(edits, best.get(term, 99))
                keys = [f"term {t} {e}" for t, e in best.items()]
                for _, edits, features in hits:
                    if edits == 0:
                        keys += ["hits", *(f"context {f}" for f in features)]
                for key in keys:
                    counts.setdefault(key, [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
             pa.array([c[1] for c in counts.values()], pa.int64())],
            names=["key", "toxic", "clean"],
        )

    return run


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct runs of ``SHINGLE`` words; a shorter text is one run."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split() or [b""]
    k = min(SHINGLE, len(words))
    runs = map(b" ".join, zip(*[words[i:] for i in range(k)]))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), dtype=np.uint64))


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts are near copies share a band (``BAND`` minimum hashes of shingles), very likely."""
    seeds = np.random.default_rng(SHINGLE).integers(0, 1 << 64, BANDS * BAND, dtype=np.uint64)
    for batch in sliced(batches, "text"):
        bands = []
        for text in batch.column("text").to_pylist():
            own = shingles(text)
            least = np.array([((own ^ s) * np.uint64(0x9E3779B97F4A7C15)).min() for s in seeds]).reshape(BANDS, BAND)
            bands += [xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least)]
        rows = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic").take(pa.array(rows)), batch.column("_row").take(pa.array(rows)),
             pa.array(np.array(bands, dtype=np.uint64).view(np.int64))],
            names=["toxic", "_row", "_band"],
        )


def _copy_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is a near copy of ``_head_text``: shingles at a Jaccard similarity of ``ALIKE`` or more."""
    for batch in sliced(batches, "text"):
        alike = []
        for text, head in zip(batch.column("text").to_pylist(), batch.column("_head_text").to_pylist()):
            own, other = shingles(text), shingles(head)
            both = len(np.intersect1d(own, other, assume_unique=True))
            alike.append(both >= ALIKE * (len(own) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch.column("_row").filter(pa.array(alike, pa.bool_()))], names=["_row"])


def _distinct_texts(sample: DataFrame, most: dict[bool, int] | None = None) -> DataFrame:
    """toxic, text: without the near copies of other texts of their label; at most about ``most`` texts each.

    Equal texts are one. A text goes only if it was compared whole with the first text of a band and
    found to be its near copy; the first text of every group of near copies stays.
    """
    texts = sample.select("toxic", F.coalesce("text", F.lit("")).alias("text")).distinct()
    texts = stored(texts.withColumn("_row", F.xxhash64("toxic", "text")), "toxicity-labelled-texts")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()} if most else {}
    if most and any(n.get(label, 0) > bound for label, bound in most.items()):  # a labelled id on very many rows
        share = F.when(F.col("toxic"), most[True] / max(1, n.get(True, 0))).otherwise(most[False] / max(1, n.get(False, 0)))
        draw = F.pmod(F.xxhash64("_row"), F.lit(1 << 40)) / float(1 << 40)
        texts = stored(texts.where(draw < share), "toxicity-sampled-texts")
    bands = stored(texts.mapInArrow(_band_batches, "toxic boolean, _row long, _band long"), "toxicity-bands")
    heads = bands.groupBy("toxic", "_band").agg(F.min("_row").alias("_head"), F.count("*").alias("_n"))
    heads = stored(heads.where("_n > 1").drop("_n"), "toxicity-band-heads")
    pairs = bands.join(heads, ["toxic", "_band"]).where("_row != _head").select("_row", "_head").distinct()
    head_texts = texts.select(F.col("_row").alias("_head"), F.col("text").alias("_head_text"))
    whole = pairs.join(texts.select("_row", "text"), "_row").join(head_texts, "_head").select("_row", "text", "_head_text")
    copies = stored(whole.mapInArrow(_copy_batches, "_row long").distinct(), "toxicity-copies")
    return texts.join(copies, "_row", "left_anti").select("toxic", "text")


def train(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 9000, least_odds: float = 3.0,
    misspelt: float = 0.02,
) -> Model:
    """Model of the labelled documents; ``misspelt`` is the prior share of a term's misspelt hits."""
    known = labels.where("toxic is not null").select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all_toxic, all_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not all_toxic or not all_clean:
        return Model()
    share = F.when(F.col("toxic"), min(1.0, toxic_rows / all_toxic)).otherwise(min(1.0, clean_rows / all_clean))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / float(1 << 40)
    picked = stored(known.where(draw < share), "toxicity-sample")  # at most about toxic_rows + clean_rows ids
    most = {True: 2 * toxic_rows, False: 2 * clean_rows}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = stored(_distinct_texts(texts.join(picked, texts["doc_id"] == picked["_id"]), most), "toxicity-texts")
    counted = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counted.get(True, 0), counted.get(False, 0)
    if not n_toxic or not n_clean:
        return Model()

    nodes = sample.where("toxic").select("text").mapInArrow(_toxic_nodes, "node string, docs long")
    nodes = stored(nodes.groupBy("node").agg(F.sum("docs").alias("docs")).where("docs >= 3"), "toxicity-nodes")
    tried = nodes.count()
    fewest = fewest_documents(tried, n_toxic, n_clean)  # a node of fewer is never significant
    toxic = {r["node"]: r["docs"] for r in nodes.where(F.col("docs") >= fewest).collect()}
    clean_nodes = sample.where("not toxic").select("text").mapInArrow(_clean_nodes(frozenset(toxic)), "node string, docs long")
    clean = {r["node"]: r["docs"] for r in clean_nodes.groupBy("node").agg(F.sum("docs").alias("docs")).collect()}
    terms = choose_terms(toxic, clean, n_toxic, n_clean, least_odds, tried)

    exact = sample.mapInArrow(_exact_batches(terms), "toxic boolean, terms array<int>").toArrow().to_pylist()
    clean_counts = Counter(t for r in exact if not r["toxic"] for t in r["terms"])
    terms = needed_terms(terms, [r["terms"] for r in exact if r["toxic"]], clean_counts, n_toxic, n_clean)

    hits = sample.mapInArrow(_hit_batches(terms), "key string, toxic long, clean long")
    hits = hits.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = {r["key"]: (r["toxic"], r["clean"]) for r in hits.collect()}  # a few keys per term
    model = Model(terms)
    for number, term in enumerate(terms):
        exact = seen.get(f"term {number} 0", (0, 0))
        for edits in range(_edits(len(term.rstrip(END))) + 1):
            t, c = seen.get(f"term {number} {edits}", (0, 0))
            expected = misspelt**edits * exact[0] if edits else 0
            odds = _log_odds(t + expected, c, n_toxic, n_clean)
            model.weights[number, edits] = odds if odds >= least_odds else 0.0
    abuse, quotation = seen.get("hits", (0, 0))
    for name, (in_abuse, in_quotation) in PRIOR_RATES.items():
        t, c = seen.get(f"context {name}", (0, 0))
        model.context[name] = math.log((t + PRIOR_HITS * in_abuse) / (abuse + PRIOR_HITS)) - math.log(
            (c + PRIOR_HITS * in_quotation) / (quotation + PRIOR_HITS)
        )
    found = sample.mapInArrow(_evidence_batches(model), "toxic boolean, evidence double").toArrow()
    toxic_row = found.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    weight = np.where(toxic_row == 1, all_toxic / n_toxic, all_clean / n_clean)
    weight = weight * len(weight) / weight.sum()
    model.slope, model.offset = fit_logistic(found.column("evidence").to_numpy(), toxic_row, weight)
    return model


def evidence(hits: list[tuple[int, int, tuple[str, ...]]], model: Model) -> float:
    """Sum of the weights of the terms that were hit, each at its strongest hit."""
    strongest: dict[int, float] = {}
    for term, edits, features in hits:
        weight = model.weights.get((term, edits), 0.0) + min(0.0, sum(model.context[f] for f in features))
        strongest[term] = max(weight, strongest.get(term, 0.0))
    return sum(strongest.values())


def _evidence_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in sliced(batches, "text"):
            found = [evidence(matcher.hits(t), model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found, pa.float64())], names=["toxic", "evidence"]
            )

    return run


def fit_logistic(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, shrink: float = 0.01) -> tuple[float, float]:
    """(slope, offset) by Newton steps; a slight pull keeps them finite when the labels separate."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (toxic - p)) - shrink * beta
        curvature = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + shrink * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(0.0, beta[0])), float(beta[1])


def score_of(hits: list[tuple[int, int, tuple[str, ...]]], model: Model) -> float:
    if model.offset == -math.inf:
        return 0.0
    logit = model.slope * evidence(hits, model) + model.offset
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for part in sliced(batches, "text"):
            found = [score_of(matcher.hits(t), model) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )
        del matcher
        release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: labels that training never sees."""
    return bucket(id_col, 4) == 2


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Model of the labels that are not held out."""
    return train(docs, labels.where(~held_out()), **options)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, with their own columns; nothing is shuffled."""
    model = learn(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for part in sliced(batches, "text"):
            texts = part.column("text").cast(pa.string()).to_pylist()
            fine = [score_of(matcher.hits(t), model) < threshold for t in texts]
            yield part.filter(pa.array(fine, pa.bool_()))
        del matcher
        release_memory()

    return docs.mapInArrow(run, docs.schema)
