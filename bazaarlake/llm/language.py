"""Language of a text by a convolutional network over its bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlake.llm.common import id_key, id_of

#: Bytes of a window; windows that are worked on at once; characters of a text that are encoded at once.
WINDOW, AT_ONCE, PIECE = 256, 512, 1_000_000
#: Numbers per byte, filters of each width in bytes.
EMBEDDING, FILTERS, WIDTHS = 8, 8, (2, 3, 4)
#: The fitting sample: rows of each language, and windows of each of these rows.
ROWS, WINDOWS = 400, 6
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Answer for texts without a letter, and where nothing was learned.
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """All of a text in rows of WINDOW bytes, the last one filled up with zeros; an empty text is one row."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


@dataclass
class Network:
    """Bytes become EMBEDDING numbers, each filter looks at its width of them, the largest answer over the
    window goes on, and a softmax chooses among the languages.

    Filters of all widths are rows of one matrix of the greatest width, zero beyond their own. Byte 0 embeds as
    zero, so what fills a window up adds nothing.
    """

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # max width * EMBEDDING x filters
    bias: np.ndarray
    weights: np.ndarray  # filters x languages
    offset: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        n, span = FILTERS * len(WIDTHS), max(WIDTHS) * EMBEDDING

        def normal(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        net = cls(
            languages,
            normal(0.5, 256, EMBEDDING),
            normal((2 / span) ** 0.5, span, n),
            np.zeros(n, np.float32),
            normal((1 / n) ** 0.5, n, len(languages)),
            np.zeros(len(languages), np.float32),
        )
        net.filters *= cls.shape()
        net.embedding[0] = 0
        return net

    @staticmethod
    def shape() -> np.ndarray:
        """1 where a filter has a weight."""
        reach = np.repeat(np.array(WIDTHS) * EMBEDDING, FILTERS)
        return (np.arange(max(WIDTHS) * EMBEDDING)[:, None] < reach).astype(np.float32)

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Windows as numbers, with room behind for the filters that reach over the edge."""
        out = np.zeros((len(rows), WINDOW + 2 * max(WIDTHS), EMBEDDING), np.float32)
        out[:, :WINDOW] = self.embedding[rows]
        return out

    def pooled(self, numbers: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest answer of each filter in each window, and where it was.

        Answers at every width-th place are one matrix product, as their inputs lie side by side; there is
        one product for each start among the first places.
        """
        step, n = max(WIDTHS), len(numbers)
        best = where = None
        for at in range(step):
            own = numbers[:, at : at + WINDOW].reshape(n, WINDOW // step, step * EMBEDDING) @ self.filters
            top = own.max(axis=1)
            place = own.argmax(axis=1) * step + at if places else None
            if best is None:
                best, where = top, place
                continue
            if places:
                where = np.where(top > best, place, where)
            best = np.maximum(best, top)
        return best + self.bias, where

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """Probability of each language for each window."""
        pooled, _ = self.pooled(self.embedded(rows))
        return softmax(np.maximum(pooled, 0) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Adam:
    """Steps for one array, by running means of its gradient and of the gradient's square."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.mean, self.square, self.n = values, np.zeros_like(values), np.zeros_like(values), 0

    def step(self, gradient: np.ndarray) -> None:
        self.n += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient**2 - self.square)
        scale = RATE * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        self.values -= scale * self.mean / (np.sqrt(self.square) + 1e-7)


def fit(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """A network for labelled windows; the same windows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, rng)
    parts = [net.embedding, net.filters, net.bias, net.weights, net.offset]
    steps = [Adam(p) for p in parts]
    span, shape = max(WIDTHS), net.shape()
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            at = order[start : start + BATCH]
            n = len(at)
            numbers = net.embedded(rows[at])
            pooled, where = net.pooled(numbers, places=True)
            hidden = np.maximum(pooled, 0)
            wrong = softmax(hidden @ net.weights + net.offset)
            wrong[np.arange(n), labels[at]] -= 1
            wrong /= n
            back = (wrong @ net.weights.T) * (pooled > 0)
            # Only the place with the largest answer has a gradient.
            seen = where[:, :, None] + np.arange(span)
            inputs = numbers[np.arange(n)[:, None, None], seen].reshape(n, len(net.bias), -1)
            filters = np.einsum("nfs,nf->sf", inputs, back) * shape
            to_numbers = (back[:, :, None] * net.filters.T).reshape(n, len(net.bias), span, EMBEDDING)
            padded = np.pad(rows[at], ((0, 0), (0, 2 * span)))
            bytes_ = padded[np.arange(n)[:, None, None], seen]
            embedding = np.zeros_like(net.embedding)
            np.add.at(embedding, bytes_.ravel(), to_numbers.reshape(-1, EMBEDDING))
            embedding[0] = 0
            gradients = [embedding, filters, back.sum(0), hidden.T @ wrong, wrong.sum(0)]
            for step, gradient in zip(steps, gradients):
                step.step(gradient)
    return net


def held_out(id_: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 divided by 4. NULL ids: no."""
    return F.coalesce(F.crc32(F.col(id_).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(lang, text, rank) of at most ``rows`` labelled documents of each language, chosen by a hash of the id.

    Languages are counted first; their counts come to the driver, as the network has weights for each of them
    there anyway. A document then stays if its hash is below the share that gives the wanted number and a
    reserve, so no more than that is shuffled and sorted, however common the language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    reserve = rows + 6 * int(rows**0.5) + 20
    bars = [(F.lit(r["lang"]), F.lit(min(1, reserve / r["n"]) * 2.0**62)) for r in sizes]
    bar = F.element_at(F.create_map(*(x for pair in bars for x in pair)), F.col("lang")) if bars else F.lit(0.0)
    chosen = labelled.select("lang", "text", F.pmod(F.xxhash64(id_key()), F.lit(2**62)).alias("order"))
    first = Window.partitionBy("lang").orderBy("order", F.xxhash64("text"))
    return (
        chosen.where(F.col("order") <= bar)
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= rows)
        .select("lang", "text", "rank")
    )


def _sampled_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows of each text, evenly spaced over all of it, joined to one value."""
    for part in parts:
        taken = []
        for text in part.column(1):
            own = windows(text.as_py().encode())
            taken.append(own[np.unique(np.linspace(0, len(own) - 1, WINDOWS).astype(int))].tobytes())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(taken, pa.binary())], ["lang", "rank", "data"])


def train(docs: DataFrame, rows: int = ROWS, seed: int = 7) -> Network | None:
    """A network fitted on a bounded sample (see ``sample``), which comes to the driver as ROWS x WINDOWS
    windows of WINDOW bytes per language; None if no document has a language."""
    taken = sample(docs, rows).mapInArrow(_sampled_windows, "lang string, rank int, data binary").collect()
    taken.sort(key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in taken})
    if not languages:
        return None
    own = [np.frombuffer(r["data"], np.uint8).reshape(-1, WINDOW) for r in taken]
    labels = np.repeat([languages.index(r["lang"]) for r in taken], [len(x) for x in own])
    return fit(np.concatenate(own), labels, languages, seed)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predictor(net: Network | None):
    def predicted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(texts: list[np.ndarray], owners: list[int]) -> None:
            rows = np.concatenate(texts)
            # A window counts by the bytes it holds.
            known = net.answers(rows) * np.count_nonzero(rows, axis=1)[:, None]
            np.add.at(sums, np.repeat(owners, [len(t) for t in texts]), known)

        for part in parts:
            sums = np.zeros((len(part), len(net.languages) if net else 1))
            texts, owners, held = [], [], 0
            for i, value in enumerate(part.column(1)):
                text = value.as_py()
                if net is None or text is None or not has_letter(text):
                    continue
                for at in range(0, len(text), PIECE):
                    own = windows(text[at : at + PIECE].encode())
                    for lo in range(0, len(own), AT_ONCE):
                        texts.append(own[lo : lo + AT_ONCE])
                        owners.append(i)
                        held += len(texts[-1])
                        if held >= AT_ONCE:
                            answered(texts, owners)
                            texts, owners, held = [], [], 0
            if texts:
                answered(texts, owners)
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            names = [net.languages[b] if t else UNKNOWN for b, t in zip(best, total)] if net else [UNKNOWN] * len(part)
            score = np.divide(sums[np.arange(len(sums)), best], total, out=np.zeros(len(sums)), where=total > 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(score.clip(0, 1))], ["id", "lang_pred", "score"]
            )

    return predicted


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text and nothing else.

    A text's score for a language is the mean over its windows, each by the bytes it holds. NULL texts, texts without a
    letter, and all texts if nothing was learned are ``und`` with score 0. Repeated rows and NULL ids have
    a row each, an empty table gives none.
    """
    found = docs.select(id_key().alias("id"), "text").mapInArrow(_predictor(net), "id long, lang_pred string, score double")
    return found.select(id_of("id").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` with a network fitted on the labelled documents among the same rows."""
    return predict(docs, train(docs))
