"""Toxicity scores from a learnt lexicon, misspellings included, read in context.

Terms that mark toxic rows are learnt from labels. Levenshtein automata of all terms,
intersected with the terms' trie, run as one automaton over every word, so a misspelled
term is found as the exact one is. What stands around a term decides whether it counts
as abuse or as quotation.
"""

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querylume.llm.common import chunks_of, dropped, remembers, written

# At most so many labelled rows of either class are learnt from, those with the smallest
# hashes; one in four of them fits the weights, the others choose the terms.
SAMPLE_ROWS = 10_000
# A term has at least so many contexts in toxic texts and is likelier there by this log odds.
LEAST_CONTEXTS, LEAST_ODDS = 4, 3.5
# The chance, over all words tried, that any one is taken for a term (or a cue of quotation)
# though it says nothing.
ALPHA = 0.01
PIECE_BYTES = 4 << 20
# A word that clean texts use this often in different surroundings is no misspelling.
CLEAN_CONTEXTS = 2
# Edits allowed in a term, by its length.
EDITS = ((9, 2), (5, 1))
EDIT_FACTOR = 0.8
# The context of a term: so many words on either side, and the marks that touch them.
CONTEXT, MARKS = 6, 3
MEMO = 300_000
STATES = 200_000
# Weights without evidence: abuse counts fully, quotation a quarter.
PRIOR = np.array([-4.0, 2.0, 0.5, 1.0])
RIDGE = 1.0

WORD = re.compile(r"[^\W_]+")
SQL_WORD = r"[^\p{L}\p{N}]+"
OPENING, CLOSING = "\"“«„‘", "\"”»“’"


class FuzzyTrie:
    """Levenshtein automata over the trie of some terms, as one automaton whose states
    are made when they are first reached."""

    def __init__(self, terms):
        self.children, self.term, self.allowed = [{}], [None], [0]
        for number, word in enumerate(terms):
            edits = next((k for n, k in EDITS if len(word) >= n), 0)
            node = 0
            for c in word:
                self.allowed[node] = max(self.allowed[node], edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], edits)
            self.term[node] = (number, edits)
        self._forget()

    def _forget(self):
        self.states, self.nodes, self.moves, self.accepts = {}, [], [], []
        self.dead, self.start = self._state({}), self._state({0: 0})

    def _state(self, reached):
        """The number of a set of trie nodes, each with its least edits so far; letters
        the word lacks are skipped at one edit each."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.allowed[child] and reached.get(child, edits + 2) > edits + 1:
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.nodes.append(key)
            self.moves.append({})
            ends = [(e, self.term[n][0]) for n, e in key if self.term[n] and e <= self.term[n][1]]
            self.accepts.append(min(ends, default=None))
        return self.states[key]

    def _move(self, state, c):
        reached = {}

        def reach(node, edits):
            if edits <= self.allowed[node] and reached.get(node, edits + 1) > edits:
                reached[node] = edits

        for node, edits in self.nodes[state]:
            for letter, child in self.children[node].items():
                reach(child, edits + (letter != c))
            reach(node, edits + 1)
        return self._state(reached)

    def match(self, word):
        """(edits, number of the term) of the nearest term within its edits, or None. States
        beyond STATES are forgotten before a word, and made again when they are reached."""
        if len(self.moves) > STATES:
            self._forget()
        state = self.start
        for c in word:
            after = self.moves[state].get(c)
            if after is None:
                after = self.moves[state][c] = self._move(state, c)
            if after == self.dead:
                return None
            state = after
        return self.accepts[state]


@dataclass
class Lexicon:
    """Terms with their weights, words that only resemble them, words that mark a term near
    them as quoted, and a memory of the words matched so far."""

    terms: list
    weights: list
    clean: frozenset = frozenset()
    cues: frozenset = frozenset()
    memo: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.trie = FuzzyTrie(self.terms)

    def find(self, words):
        """The words that are terms: {word: weight}."""
        remembers(self)
        memo = self.memo
        new = words.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = words
        for word in new:
            got = None if word in self.clean else self.trie.match(word)
            memo[word] = got and self.weights[got[1]] * EDIT_FACTOR ** got[0]
        return {w: memo[w] for w in words if memo[w]}

    def __getstate__(self):
        return {c: getattr(self, c) for c in ("terms", "weights", "clean", "cues")}

    def __setstate__(self, state):
        self.__init__(**state)


def _near(words, i):
    return words[max(0, i - CONTEXT):i + CONTEXT + 1]


def _quoted(text, words, i, cues):
    """Whether the i-th of ``words`` (matches) is quoted: a mark opens before it and
    closes after it within the context window, or a learnt cue stands near."""
    near = _near(words, i)
    if cues and any(m[0] in cues for m in near):
        return True
    before = text[max(0, near[0].start() - MARKS):words[i].start()]
    after = text[words[i].end():near[-1].end() + MARKS]
    opens = max((before.rfind(c) for c in OPENING), default=-1)
    closes = max((before.rfind(c) for c in CLOSING if c not in OPENING), default=-1)
    straight = before.count('"') % 2 == 1 if opens >= 0 and before[opens] == '"' else opens >= 0
    return straight and closes < opens and any(c in after for c in CLOSING)


def features(text, lexicon):
    """Of a text: 1, abuse and quotation (logarithms of the summed weights of the terms
    that occur so), and the strongest weight of abuse."""
    low = (text or "").lower()
    found = lexicon.find(set(WORD.findall(low)))
    abuse, quoted = {}, {}
    if found:
        words = list(WORD.finditer(low))
        for i, m in enumerate(words):
            if m[0] in found:
                (quoted if _quoted(low, words, i, lexicon.cues) else abuse)[m[0]] = found[m[0]]
    strongest = max(abuse.values(), default=0.0) / 4
    return 1.0, np.log1p(sum(abuse.values())), np.log1p(sum(quoted.values())), strongest


def _fit(x, y, weights):
    """Logistic regression by Newton steps, drawn to PRIOR with the strength of RIDGE."""
    beta = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weights * (y - p)) - RIDGE * (beta - PRIOR)
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def is_held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs, labels, sample_rows):
    """Texts of the labelled rows learnt from: place, text, toxic, fold. The rows chosen are at
    most twice ``sample_rows``, so joining them to the documents may broadcast them."""
    named = (
        labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic")).filter(~is_held_out("doc_id"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    chosen = [
        named.filter(F.col("toxic") == kind).orderBy("place").limit(sample_rows) for kind in (0, 1)
    ]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select(
        "place", "text", "toxic", F.pmod(F.xxhash64("place"), F.lit(4)).alias("fold"))


def _word_counts(sample):
    """Per word the number of its surroundings in toxic texts (a) and in clean ones (b).
    Every text counts once for a word, by one of the word's surroundings in it, and equal
    surroundings count once: neither a long text nor copies lend a word weight."""
    words = F.array_remove(F.split(F.lower("text"), SQL_WORD), "")
    places = sample.select("place", "toxic", words.alias("w")).select("place", "toxic", F.expr("""
        explode(transform(w, (word, i) -> struct(
            word, xxhash64(get(w, i - 1), get(w, i + 1)) AS context)))"""
    ).alias("x")).select("place", "toxic", "x.*").filter(F.length("word") >= 3)
    once = places.groupBy("place", "word").agg(
        F.min("context").alias("context"), F.max("toxic").alias("toxic"))
    return once.groupBy("word", "context").agg(
        F.max("toxic").alias("t"), F.min("toxic").alias("c")).groupBy("word").agg(
        F.sum("t").alias("a"), F.sum(1 - F.col("c")).alias("b"))


def _surprise(hits, misses, share):
    """Logarithm of how unlikely it is at most (Chernoff's bound) that so many of a word's
    occurrences are hits, if it had the general ``share`` of them; 0 if it has no more."""
    n = hits + misses
    rate = hits / n
    rest = F.when(misses > 0, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    return F.when(rate > share, n * (rate * F.log(rate / share) + rest)).otherwise(0.0)


def _learn_lexicon(sample):
    """The terms that mark toxic texts, weighted by their log odds. How many words could be
    terms by their number of occurrences decides how sure one must be: the more are tried,
    the less chance each is given."""
    spark = sample.sparkSession
    counts = written(_word_counts(sample), "word-counts")
    tried = F.count_if(F.col("a") + F.col("b") >= LEAST_CONTEXTS)
    totals = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), tried.alias("tried")).first()
    if not totals["a"] or not totals["b"]:
        return Lexicon([], [])
    odds = F.log((F.col("a") + 0.5) / (F.col("b") + 0.5)) - float(
        np.log(totals["a"] + 0.5) - np.log(totals["b"] + 0.5))
    share = totals["a"] / (totals["a"] + totals["b"])
    surprise = _surprise(F.col("a"), F.col("b"), share)
    best = counts.filter(F.col("a") >= LEAST_CONTEXTS).select("word", odds.alias("odds"), surprise.alias("s"))
    best = best.filter((F.col("s") >= float(np.log(max(1, totals["tried"]) / ALPHA))) & (F.col("odds") >= LEAST_ODDS))
    rows = best.orderBy(F.desc("s"), "word").collect()
    terms, weights = [r["word"] for r in rows], [r["odds"] for r in rows]
    lexicon = spark.sparkContext.broadcast(Lexicon(terms, weights))

    def resembling(batches):
        for batch in batches:
            match = lexicon.value.trie.match
            near = [w for w in batch.column("word").to_pylist() if (match(w) or (0,))[0] > 0]
            yield pa.RecordBatch.from_pydict({"word": pa.array(near, pa.string())})

    # Of the words of a bounded sample only those an edit or two from a term come back.
    clean = counts.filter(F.col("b") >= CLEAN_CONTEXTS).select("word")
    found = frozenset(r["word"] for r in clean.mapInArrow(resembling, "word string").collect())
    dropped(spark, counts)
    return Lexicon(terms, weights, found, _learn_cues(sample, Lexicon(terms, weights, found)))


def _learn_cues(sample, lexicon):
    """Words that stand near terms in clean texts so much oftener than the same terms do
    without them that they mark quotation. Each term is held against itself, so that words
    of a language, or of a kind of text, are not taken for cues. A text counts once for a
    word and a term. None if no clean text has a term."""
    if not lexicon.terms:
        return frozenset()
    sent = sample.sparkSession.sparkContext.broadcast(lexicon)

    def around(batches):
        trie, terms = sent.value.trie, sent.value.terms
        for batch in chunks_of(batches, PIECE_BYTES):
            out = []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                low = (text.as_py() or "").lower()
                words = list(WORD.finditer(low))
                found = {w: terms[trie.match(w)[1]] for w in sent.value.find({m[0] for m in words})}
                near = {(m[0], found[w[0]]) for i, w in enumerate(words) if w[0] in found for m in _near(words, i)}
                out += [(w, t, toxic) for w, t in near if w not in found]
                out += [("", t, toxic) for t in set(found.values())]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                names=["word", "term", "toxic"])

    seen = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(
        around, "word string, term string, toxic long")
    counts = written(seen.groupBy("word", "term").agg(
        F.count_if(F.col("toxic") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b")), "cue-counts")
    # The empty word counts the texts with a term: its share of clean ones.
    shares = counts.filter("word = ''").select("term", (F.col("a") / (F.col("a") + F.col("b"))).alias("share"))
    n = F.col("a") + F.col("b")
    words = counts.filter("word <> ''").join(shares, "term").groupBy("word").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), (F.sum(n * F.col("share")) / F.sum(n)).alias("share"))
    words = written(words.filter(n >= LEAST_CONTEXTS), "cue-words")
    usable = words.filter((F.col("share") > 0) & (F.col("share") < 1))
    sure = _surprise(F.col("a"), F.col("b"), F.col("share")) >= float(np.log(max(1, words.count()) / ALPHA))
    cues = frozenset(r["word"] for r in usable.filter(sure).select("word").collect())
    dropped(sample.sparkSession, counts, words)
    return cues


def _mapping(lexicon, beta, schema):
    def score(batches):
        words = lexicon.value
        for batch in chunks_of(batches, PIECE_BYTES):
            x = np.array([features(t.as_py(), words) for t in batch.column("text")])
            x = x.reshape(batch.num_rows, 4)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            if beta is None:
                columns["x"] = x.tolist()
            else:
                columns["score"] = 1 / (1 + np.exp(-x @ beta))
            yield pa.RecordBatch.from_pydict(columns, schema=schema)
    return score


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray


def train(docs: DataFrame, labels: DataFrame, sample_rows=SAMPLE_ROWS) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic)
    marks, without those held out. Rows that repeat a doc_id are toxic if one of them is;
    null labels count as none. Without rows of both classes nothing is toxic."""
    sample = _sample(docs, labels, sample_rows)
    lexicon = _learn_lexicon(sample.filter("fold < 3"))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("toxic", pa.int64()), ("x", pa.list_(pa.float64()))])
    fitted = sample.filter("fold = 3").select(F.col("toxic").cast("long"), "text").mapInArrow(
        _mapping(sent, None, schema), "toxic long, x array<double>").collect()
    beta = PRIOR.copy()
    if lexicon.terms and fitted:
        y = np.array([r["toxic"] for r in fitted], float)
        beta = _fit(np.array([r["x"] for r in fitted]), y, np.ones(len(y)))
    return Model(lexicon, beta)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score is at least 0.5) of every row
    of ``docs``; more columns are ignored. A null text is an empty one: it has no terms
    and is scored like any text without them."""
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64())])
    scored = docs.select("doc_id", "text").mapInArrow(
        _mapping(sent, model.beta, schema), f"doc_id {kind.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns. A null text
    has no terms; rows without an id, and repeated ones, are judged like any others."""
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    beta, text = model.beta, docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            x = np.array([features(t.as_py(), sent.value) for t in batch.column(text)])
            p = 1 / (1 + np.exp(-x.reshape(batch.num_rows, 4) @ beta))
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(keep, docs.schema)
