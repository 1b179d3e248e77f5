"""Language identification with spans of mixed-language text.

Each word is scored for each learned language by its character n-grams; only languages written in the word's script (by
ranges of code points) are candidates. A Viterbi pass over the words, in which a change of language costs SWITCH, labels
spans; the language with most letters in its spans is the text's, and its share of the letters is the score.

The n-gram counts come from all labelled texts. Each n-gram counts at the slot that its hash names, of SLOTS; so all n-grams
count, and the model that is sent to the executors has 4 bytes a slot and language, whatever the texts hold. A null or empty
text, or one without a letter, is `und` with score 0. Very long texts are read whole. With nothing to learn from, all texts
are `und`. Repeated rows and ids and null ids are kept, extra columns ignored; an empty table gives an empty result. Of
equally good languages the first by name is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, pieces, split_words, stored
from .minhash import U, mix

SLOTS = 1 << 20
#: Cost of a change of language, in natural log units; add-SMOOTH of the n-gram probabilities.
SWITCH, SMOOTH = 12.0, 0.5
#: Bytes of text that are labelled at once.
PIECE = 2_000_000
#: Distinct words whose n-grams are taken at once.
WORDS = 20_000
#: Languages whose counts a task gathers before it sends them on.
GATHERED = 8
#: A language is written in a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: A letter belongs to a language's alphabet with this share of its letters.
LETTER_SHARE = 1e-4
#: A text fits if words with this share of its letters are explained by a language; on sf0.1 all have 0.36, random letters 0.05.
FITTING = 0.25
UND = "und"

#: Fixed ranges of code points (first, last) of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}


_TABLE = sorted((a, b, i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_STARTS, _ENDS, _NUMBERS = (np.array([r[k] for r in _TABLE]) for k in range(3))
OTHER = len(SCRIPTS)


def scripts_of(signs: np.ndarray) -> np.ndarray:
    """The number of each code point's script; OTHER outside all ranges."""
    at = np.maximum(np.searchsorted(_STARTS, signs, side="right") - 1, 0)
    return np.where((signs >= _STARTS[at]) & (signs <= _ENDS[at]), _NUMBERS[at], OTHER)


def letters(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.large_string())), r"[^\p{L}]", "")


class Signs:
    """The letters of words (none empty) as code points with a blank before and after each word, and their n-grams."""

    def __init__(self, words: pa.Array):
        text = " " + "".join([w + " " for w in words.to_pylist()])
        self.signs = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        blank = self.signs == 32
        self.size = np.diff(np.nonzero(blank)[0]) - 1
        word = np.cumsum(blank) - 1
        letter = np.nonzero(~blank)[0]
        self.letters, self.letter_word = self.signs[letter], word[letter]
        two = np.arange(1, len(text))
        of_two = word[two] - blank[two]  # a closing blank belongs to the word before it
        three = np.arange(2, len(text))
        three = three[~blank[three - 1]]
        # One to three letters, as one number each: no letter is 0, so the lengths stay apart.
        grams = [self.letters, self.signs[two - 1] << 21 | self.signs[two], self.signs[three - 2] << 42 | self.signs[three - 1] << 21 | self.signs[three]]
        self.slots = np.concatenate([(mix(g.astype(U)) & U(SLOTS - 1)).astype(np.int32) for g in grams])
        self.words = np.concatenate([self.letter_word, of_two, word[three] - blank[three]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Keys of counts below 0: -1 - k for letters in script k, and A_LETTER - x for the letter x.
A_LETTER = -100


def _count(batches):
    """(lang, key, n): how often each language's texts hold n-grams of each slot, letters of each script, and each letter."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # of each language by slot and by letter

    def sent():
        for name, (slots, letter) in held.items():
            at = np.nonzero(letter)[0]
            script = np.bincount(scripts_of(at), letter[at], OTHER + 1)
            used = [np.nonzero(x)[0] for x in (slots, script)]
            keys, n = np.concatenate([used[0], -1 - used[1], A_LETTER - at]), np.concatenate([slots[used[0]], script[used[1]], letter[at]])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(keys), pa.string()), "gram": keys, "n": n.astype(np.int64)})
        held.clear()

    for b in pieces(batches, most=PIECE):
        words, of = split_words(b.column("text"))
        names, at = numbered(letters(words)) if len(words) else (pa.array([], pa.string()), np.zeros(0, np.int64))
        langs = b.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of]
        full = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
        if not full.any():
            continue
        place = np.cumsum(full) - 1
        lang, at = lang[full[at]], place[at[full[at]]]
        names = names.filter(pa.array(full))
        counts = [np.bincount(at[lang == k], minlength=len(names)) for k in range(len(langs.dictionary))]
        for start in range(0, len(names), WORDS):
            signs = Signs(names.slice(start, WORDS))
            for name, all_ in zip(langs.dictionary.to_pylist(), counts, strict=True):
                n = all_[start : start + WORDS]
                if n.any():
                    slots, letter = held.get(name, (np.zeros(SLOTS, np.int32), np.zeros(0)))
                    np.add.at(slots, signs.slots, n[signs.words].astype(np.int32))
                    here = np.bincount(signs.letters, n[signs.letter_word], len(letter))
                    here[: len(letter)] += letter
                    held[name] = slots, here
        if len(held) > GATHERED:
            yield from sent()
    yield from sent()


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, scripts: np.ndarray, alphabet: np.ndarray):
        """logs: a row a language and a column a slot; scripts: whether each is used by each; alphabet: letters of each."""
        self.langs, self.logs, self.scripts, self.alphabet = langs, logs, scripts, alphabet

    def scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of each word for each language, number of its letters, whether some language explains it).

        Languages of other scripts score far below. A language explains a word of its scripts that is at least as likely in
        it as if each letter and blank were drawn from its alphabet at random.
        """
        explained = np.zeros(len(words), bool)
        out, size = np.zeros((len(words), len(self.langs)), np.float32), np.zeros(len(words), np.int64)
        own = letters(words)
        full = np.nonzero(pc.not_equal(own, "").to_numpy(zero_copy_only=False))[0]
        for start in range(0, len(full), WORDS):
            at = full[start : start + WORDS]
            out[at], size[at], explained[at] = self._scores(own.take(pa.array(at)))
        return out, size, explained

    def _scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        signs = Signs(words)
        script, found = scripts_of(signs.letters), []
        for k in range(len(self.langs)):
            able = np.ones(len(signs.size), bool)
            able[signs.letter_word[~self.scripts[script, k]]] = False
            found.append((np.bincount(signs.words, self.logs[k][signs.slots], len(signs.size)), able))
        able = np.stack([a for _, a in found], axis=1)
        random = -(6 * signs.size[:, None] + 2) * np.log(self.alphabet) - (3 * signs.size[:, None] + 1) * np.log(3)
        value = np.stack([v for v, _ in found], axis=1)
        # A word in scripts of no language, or in mixed ones, keeps all candidates.
        return value - 1e4 * (~able & able.any(axis=1)[:, None]), signs.size, (able & (value >= random)).any(axis=1)


def train(labelled: DataFrame) -> Model:
    """The model of labelled (lang, text)."""
    counts = labelled.filter("lang is not null and text is not null").mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    by_script = counts.filter(f"gram < 0 and gram > {A_LETTER}").collect()  # languages by scripts
    langs = sorted({r.lang for r in by_script})
    held = np.zeros((OTHER + 1, len(langs)))
    for r in by_script:
        held[-1 - r.gram, langs.index(r.lang)] = r.n
    share = held / np.maximum(held.sum(axis=0), 1)
    letter = counts.filter(f"gram <= {A_LETTER}")
    of = letter.groupBy("lang").agg((F.sum("n") * LETTER_SHARE).alias("least"))
    alphabet = np.ones(len(langs))
    for r in letter.join(of, "lang").filter("n > least").groupBy("lang").count().collect():  # a row a language
        alphabet[langs.index(r.lang)] += r["count"]
    slots = counts.filter("gram >= 0").toArrow()  # at most SLOTS rows a language
    n = np.zeros((len(langs), SLOTS), np.float32)
    if slots.num_rows:
        n[pc.index_in(slots.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy(), slots.column("gram").to_numpy()] = slots.column("n").to_numpy()
    total = n.sum(axis=1, dtype=np.float64) + SMOOTH * (1 + np.count_nonzero(n.any(axis=0)))
    n += np.float32(SMOOTH)
    np.log(n, out=n)
    return Model(langs, n - np.log(total)[:, None].astype(np.float32), share >= SCRIPT_SHARE, alphabet)


def viterbi(scores: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """The language of each word on the best way through its text; scores by word, of: the text of each, in order.

    All texts go one word ahead at a time, longest first, so that the work is done on whole columns.
    """
    n = np.bincount(of, minlength=texts)
    starts = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    first, lengths = starts[order], n[order]
    best = np.zeros((texts, scores.shape[1]))
    stay = np.zeros(scores.shape, bool)  # whether the word before has the same language
    come = np.zeros(len(scores), np.int32)  # else the language that it has
    for t in range(lengths[0] if texts else 0):
        k = int(np.searchsorted(-lengths, -t, side="left"))  # texts with more than t words
        at = first[:k] + t
        if t:
            top = best[:k].argmax(axis=1)
            change = best[np.arange(k), top] - SWITCH
            stay[at] = best[:k] >= change[:, None]
            come[at] = top
            best[:k] = np.maximum(best[:k], change[:, None])
        best[:k] += scores[at]
    out = np.zeros(len(scores), np.int32)
    now = best.argmax(axis=1).astype(np.int32)
    for t in range((lengths[0] if texts else 0) - 1, -1, -1):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        at = first[:k] + t
        out[at] = now[:k]
        keep = stay[at, now[:k]] if t else np.ones(k, bool)
        now[:k] = np.where(keep, now[:k], come[at])
    return out


def _label(model: Model, fit: bool = False):
    """fit: with a last column, the share of the letters in words that some language explains."""

    def run(batches):
        for b in pieces(batches, most=PIECE):
            words, of = split_words(b.column("text"))
            names, at = numbered(words)
            texts, count = b.num_rows, max(1, len(model.langs))
            if len(model.langs) and len(names):
                each, size, explained = model.scores(names)
                fitting = np.bincount(of, (size * explained)[at], texts)
                lettered = size[at] > 0
                at, of = at[lettered], of[lettered]
                label = viterbi(each[at], of, texts)
                share = np.bincount(of * count + label, size[at], texts * count).reshape(texts, count)
                change = np.ones(len(of), bool)
                change[1:] = (of[1:] != of[:-1]) | (label[1:] != label[:-1])
                spans = np.bincount(of[change], minlength=texts)
            else:
                share, spans, fitting = np.zeros((texts, count)), np.zeros(texts, np.int64), np.zeros(texts)
            total, top = share.sum(axis=1), share.argmax(axis=1)
            langs = [model.langs[k] if n else UND for k, n in zip(top, total, strict=True)]
            score = np.where(total > 0, share[np.arange(texts), top] / np.maximum(total, 1), 0.0)
            columns, names = [b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(spans.astype(np.int64))], ["doc_id", "lang_pred", "score", "n_spans"]
            if fit:
                columns, names = [*columns, pa.array(fitting / np.maximum(total, 1))], [*names, "fit"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, n_spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_label(model), f"doc_id {kind}, lang_pred string, score double, n_spans bigint")


def query(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    return identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that a learned language fits, with their columns; a null language is filled with the one found."""

    def run(batches):
        label = _label(model, True)
        for b in pieces(batches, text_col, PIECE):
            own = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(text_col)], names=["doc_id", "text"])
            found = pa.Table.from_batches(label([own])).combine_chunks()
            if lang_col in b.schema.names:
                at, lang = b.schema.get_field_index(lang_col), b.column(lang_col)
                filled = pc.coalesce(lang, found.column("lang_pred").combine_chunks().cast(lang.type))
                b = pa.RecordBatch.from_arrays([filled if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)
            yield b.filter(pc.and_(pc.not_equal(found.column("lang_pred"), UND), pc.greater_equal(found.column("fit"), FITTING)).combine_chunks())

    return docs.mapInArrow(run, docs.schema)
