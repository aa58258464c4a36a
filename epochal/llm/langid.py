"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language. Its features are the word itself (the lexicon), its affixes and its n-grams, hashed
into at most FEATURES weights per language (fewer where there are more than 64 languages, so that WEIGHTS bounds them all); transitions
between the languages of neighbouring words are learned with them, by the gradient of the log-likelihood. Prediction runs forward-backward over all words of a text and sums the words' marginals, so a
text that switches languages gets the one of most of its words, and the score is that language's share.

The field is trained on the driver on a bounded sample of labelled rows: SAMPLE in all, PER_LANGUAGE of a language at most, drawn by a
hash of doc_id and text from the documents that are not held out, of every language (if there are more than LANGUAGES, of the LANGUAGES
commonest, the bound of the sample's classes). Of a document longer than LONGEST characters the sample has that many from a hashed place, and of each document up to
STRETCHES stretches of STRETCH words from all over it. Their labels are for whole documents, so training sequences splice stretches
of different documents, which is what teaches the transitions. Everything else runs on all texts, whole: a word's features are
taken from all its letters, however long it is.

Forward-backward is exact for texts of any length. With up to FEW languages, words are laid out in lanes of LANE words over all texts of a
batch, each lane's transfer matrix is computed by itself, lanes are chained along each text, and the lanes' words are then filled in. With more
languages a matrix would cost more than it saves: each text is one lane, and all texts' vectors take each step together. Either way memory
is a few numbers per word and language, and a batch of texts ends where it has STATES of them (a longer text is a batch of its own).

Defined cases: null texts and texts without a letter get und and score 0, as do all if there is nothing to learn from; a tie goes
to the first language by name; repeated rows and ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from epochal.llm.common import kept, spread, table, unused

#: Bounds of the labelled sample.
SAMPLE, PER_LANGUAGE, LANGUAGES, LONGEST, STRETCHES, STRETCH = 32_000, 500, 2_048, 20_000, 20, 24
#: Languages up to which lanes are shorter than texts, and numbers per batch of texts.
FEW, STATES = 16, 1 << 22
FEATURES, WEIGHTS, LANE, EPOCHS, RATE, DECAY = 1 << 17, 1 << 23, 32, 3, 0.2, 1e-6
#: Words and their characters that a worker remembers, characters of text split at once, and bytes of words hashed at once.
REMEMBERED, KEPT, PIECE, HASHED = 150_000, 1 << 22, 1 << 20, 1 << 18
#: The share below which a text is in no language.
LEAST_SCORE = 0.35
WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    code = np.full(len(at), n, np.uint32)
    for k in range(n):
        code = (code ^ data[at + k]) * np.uint32(0x01000193)
    return code


def features(words: list[str], count: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of the words, numbers under count (a power of two), one word after another, and how many each has. Hashed are the
    word itself and, of its bytes with its ends marked, all runs of two and three and the runs of four and five at either end."""
    marked = [f"^{w}$".encode() for w in words]
    size = np.array([len(m) for m in marked])
    ends = np.cumsum(size)
    begin, data = ends - size, np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner, place = np.repeat(np.arange(len(words)), size), np.arange(len(data))
    left = ends[owner] - place
    owners, codes = [np.arange(len(words))], [np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint32)]
    for n in (2, 3, 4, 5):
        fits = left >= n
        if n > 3:
            fits &= (place == begin[owner]) | (left == n)
        at = np.flatnonzero(fits)
        owners.append(owner[at])
        codes.append(grams(data, at, n))
    code, owner = np.concatenate(codes), np.concatenate(owners)
    code = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    code = (code ^ code >> np.uint32(12)) & np.uint32(count - 1)
    return code[np.argsort(owner, kind="stable")].astype(np.int64), np.bincount(owner, minlength=len(words))


class Words:
    """Numbers of words, and their features' weights summed. Holds a bounded number of words and characters."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.numbers, self.new, self.kept = weights, {}, [], 0
        self.scores = np.empty((0, weights.shape[1]), weights.dtype)

    def number(self, word: str) -> int:
        self.new.append(word)
        self.numbers[word] = k = len(self.numbers)
        return k

    def of(self, text: str) -> np.ndarray:
        get, number, out = self.numbers.get, self.number, []
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and text[end].isalpha():
                end += 1
            words = WORD.findall(text[at:end].lower())
            out.append(np.array([k if (k := get(w)) is not None else number(w) for w in words], dtype=np.int32))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def emissions(self) -> np.ndarray:
        found, part, held = [self.scores], [], 0
        for word in [*self.new, None]:
            if part and (word is None or held + len(word) > HASHED):
                flat, count = features(part, len(self.weights))
                found.append(np.add.reduceat(self.weights[flat], np.cumsum(count) - count))
                part, held = [], 0
            if word is not None:
                part.append(word)
                held += len(word)
        self.kept += sum(map(len, self.new))
        self.new, self.scores = [], np.concatenate(found)
        return self.scores

    def forget(self) -> None:
        if len(self.numbers) > REMEMBERED or self.kept > KEPT or self.scores.size > 4 * STATES:
            self.numbers, self.scores, self.kept = {}, self.scores[:0], 0


def forward_backward(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What leads up to each word and its language, what follows, and the weights of emissions and moves, each word's up to a factor.
    scores are the emissions of the texts' words, one text after another, of the given lengths."""
    n, k = scores.shape
    lengths = lengths[lengths > 0]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(moves - moves.max())
    lane = LANE if k <= FEW else int(lengths.max(initial=1))
    per_text = -(-lengths // lane)
    lanes, text = int(per_text.sum()), np.repeat(np.arange(len(lengths)), per_text)
    first = np.cumsum(per_text) - per_text
    nth = np.arange(lanes) - first[text]
    begin = (np.cumsum(lengths) - lengths)[text] + nth * lane
    size = np.minimum(lane, lengths[text] - nth * lane)
    by_size = np.argsort(-size, kind="stable")
    live_at = np.searchsorted(-size[by_size], -np.arange(lane), side="left")  # how many lanes reach beyond a step

    # the transfer of each lane of a text of several: from the language before it to that of its last word
    several = k <= FEW and per_text.max(initial=0) > 1
    through = np.repeat(np.eye(k)[None], lanes if several else 0, axis=0)
    for t in range(lane if several else 0):
        live = by_size[: live_at[t]]
        m = (through[live].reshape(-1, k) @ move).reshape(-1, k, k) * emit[begin[live] + t][:, None, :]
        through[live] = m / m.max(axis=(1, 2), keepdims=True)

    # along each text: what enters a lane, and what leaves it backwards
    ahead, behind = np.full((lanes, k), 1.0 / k), np.ones((lanes, k))
    by_nth = np.argsort(nth, kind="stable")
    edges = np.searchsorted(nth[by_nth], np.arange(int(per_text.max(initial=0)) + 1))
    for j in range(1, len(edges) - 1):
        at = by_nth[edges[j] : edges[j + 1]]
        x = np.einsum("ni,nij->nj", ahead[at - 1], through[at - 1])
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    for j in range(len(edges) - 2, 0, -1):
        at = by_nth[edges[j] : edges[j + 1]]
        x = np.einsum("nij,nj->ni", through[at], behind[at])
        behind[at - 1] = x / x.sum(axis=1, keepdims=True)

    # within lanes; the first word of a text has no move into it, and a uniform language before it is as good
    start = np.full((k, k), 1.0 / k)
    alpha, beta, opening = np.empty((n, k)), np.empty((n, k)), nth == 0
    for t in range(lane):
        live = by_size[: live_at[t]]
        x = ahead[live] @ move if t else np.where(opening[live][:, None], ahead[live] @ start, ahead[live] @ move)
        x *= emit[begin[live] + t]
        x /= x.sum(axis=1, keepdims=True)
        ahead[live] = alpha[begin[live] + t] = x
    for t in range(lane - 1, -1, -1):
        live = by_size[: live_at[t]]
        beta[begin[live] + t] = behind[live]
        x = (behind[live] * emit[begin[live] + t]) @ move.T
        behind[live] = x / x.sum(axis=1, keepdims=True)
    return alpha, beta, emit, move


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of all words of all texts."""
    alpha, beta, _, _ = forward_backward(scores, moves, lengths)
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def gradient(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the true languages by scores and by moves: what is observed less what is expected."""
    alpha, beta, emit, move = forward_backward(scores, moves, lengths)
    pull = -alpha * beta
    pull /= -pull.sum(axis=1, keepdims=True)
    pull[np.arange(len(truth)), truth] += 1
    inside = np.ones(len(truth), bool)
    inside[np.cumsum(lengths[lengths > 0]) - 1] = False
    at = np.flatnonzero(inside)
    after = emit[at + 1] * beta[at + 1]
    push = -move * ((alpha[at] / ((alpha[at] @ move) * after).sum(axis=1, keepdims=True)).T @ after)
    np.add.at(push, (truth[at], truth[at + 1]), 1)
    return pull, push


def parts(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the texts that have words, in runs of so many words at most; a longer text is a run of its own."""
    run, held = [], 0
    for i in np.flatnonzero(lengths).tolist():
        if run and held + lengths[i] > most:
            yield np.array(run)
            run, held = [], 0
        run.append(i)
        held += lengths[i]
    if run:
        yield np.array(run)


class Field:
    """languages, weights and moves."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.moves = languages, weights, moves

    @staticmethod
    def trained(texts: list[str], labels: list[str], seed: int = 0) -> Field:
        languages = sorted(set(labels))
        features_kept = FEATURES
        while features_kept * len(languages) > WEIGHTS and features_kept > 1 << 12:
            features_kept >>= 1
        weights, moves = np.zeros((features_kept, len(languages))), np.zeros((len(languages),) * 2)
        seen, draw = Words(weights), np.random.default_rng(seed)
        stretches, kinds = [], []
        for text, label in zip(texts, labels):
            words = seen.of(text)
            places = np.arange(0, len(words), STRETCH)
            if len(places) > STRETCHES:
                places = places[np.linspace(0, len(places) - 1, STRETCHES).astype(int)]
            for at in places.tolist():
                stretches.append(words[at : at + STRETCH])
                kinds.append(languages.index(label))
        if not stretches:
            return Field(languages, weights, moves)
        flat, count = features(seen.new, features_kept)
        begin = np.append(0, np.cumsum(count))
        grown, moved = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)
        for _ in range(EPOCHS):
            order = draw.permutation(len(stretches))
            for at in range(0, len(order), 256):
                # sequences of three stretches, so of one to three languages
                part = order[at : at + 256]
                lengths = np.array([sum(len(stretches[i]) for i in part[j : j + 3]) for j in range(0, len(part), 3)])
                words = np.concatenate([stretches[i] for i in part])
                truth = np.repeat([kinds[i] for i in part], [len(stretches[i]) for i in part])
                unique, place = np.unique(words, return_inverse=True)
                count = begin[unique + 1] - begin[unique]
                edge = np.cumsum(count) - count
                rows = flat[np.repeat(begin[unique] - edge, count) + np.arange(count.sum())]
                scores = np.add.reduceat(weights[rows], edge)[place]
                pull, push = gradient(scores, moves, lengths, truth)
                by_word = np.stack([np.bincount(place, c, len(unique)) for c in pull.T], axis=1)
                used, where = np.unique(rows, return_inverse=True)
                step = np.stack([np.bincount(where, np.repeat(c, count), len(used)) for c in by_word.T], axis=1) / len(part)
                step -= DECAY * weights[used]
                grown[used] += step**2
                weights[used] += RATE * step / np.sqrt(grown[used])
                push = push / len(part) - DECAY * moves
                moved += push**2
                moves += RATE * push / np.sqrt(moved)
        return Field(languages, weights.astype(np.float32), moves)


def trained_on(docs: DataFrame) -> Field:
    """The field for the documents that are not held out; see above for the sample's bounds."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Field([], np.zeros((1, 0)), np.zeros((0, 0)))
    most = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    names = sorted(counts)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1
    share = F.get(F.array(*(F.lit(min(1.0, 2 * most / counts[x])) for x in names)), place)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.withColumn("draw", draw).filter((place >= 0) & (F.col("draw") < share))
    # about twice as many as wanted, so that there are enough; repeated rows share a draw, hence the exact limit
    size = F.char_length("text")
    begin = F.when(size > LONGEST, F.pmod(F.xxhash64("text"), size - LONGEST)).otherwise(F.lit(0)) + 1
    drawn = drawn.select("lang", "draw", "doc_id", F.substring("text", begin.cast("int"), F.lit(LONGEST)).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    rows = drawn.withColumn("nth", nth).filter(F.col("nth") <= most).collect()
    rows.sort(key=lambda r: (r["lang"], r["nth"]))
    return Field.trained([r["text"] for r in rows], [r["lang"] for r in rows])


def labelled(rows: DataFrame, field: Field, names: list[str]) -> DataFrame:
    """rows and two more columns, the language and the score, under these names. rows: any columns, the last of which is the text."""
    # WEIGHTS numbers at most, whatever the corpus
    shared = rows.sparkSession.sparkContext.broadcast((field.languages, field.weights, field.moves))
    number = zlib.crc32(field.weights.tobytes()) << 32 | zlib.crc32(field.moves.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, moves = shared.value
        seen = kept(("words", number), lambda: Words(weights))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [seen.of(x.as_py() or "") for x in part.columns[-1]] if languages else [np.empty(0, np.int32)] * part.num_rows
                lengths = np.array([len(w) for w in words])
                best, score = np.full(len(words), -1), np.zeros(len(words))
                scores = seen.emissions()
                for some in parts(lengths, max(1, STATES // max(1, len(languages)))):
                    found = marginals(scores[np.concatenate([words[i] for i in some])].astype(np.float64), moves, lengths[some])
                    share = np.add.reduceat(found, np.cumsum(lengths[some]) - lengths[some]) / lengths[some][:, None]
                    best[some], score[some] = share.argmax(axis=1), np.minimum(share.max(axis=1), 1.0)
                seen.forget()
                found = [languages[i] if i >= 0 else "und" for i in best]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(score)], [*part.schema.names, *names])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def predicted(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    found = labelled(spread(docs.select("doc_id", "text")), field, ["lang_pred", "score"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those that have no letter, or in which no language has so large a share. The columns stay; where lang was null
    it is the predicted one."""
    lang, score = unused(docs, "found_lang", "found_score")
    found = labelled(spread(docs).select(*(c for c in docs.columns if c != "text"), "text"), trained_on(docs), [lang, score])
    found = found.filter((F.col(lang) != "und") & (F.col(score) >= least))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def identified(docs: DataFrame) -> DataFrame:
    return predicted(docs, trained_on(docs))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
