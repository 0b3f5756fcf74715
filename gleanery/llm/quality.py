"""Text statistics per document, its lines labelled prose, list, table or junk by a hidden Markov model."""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "list", "table", "junk")
_WORD = re.compile(r"[^\W_]+")
_CLOSING = "\"')]»”’ \t\r"
_END = frozenset(".!?…。！？:;")
_COMMA = frozenset(",-–—")
_DIGIT = re.compile(r"\d+")
_BULLET = re.compile(r"\s*(?:[-*•·–+o]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s")
_LEADERS = ("....", ". . . .", "____")
_RECORD = re.compile(r"[{\[\"<].*[:=].*[}\]\">],?\s*$|[\w.\-]{1,30}\s*=\s*\S+\s*$|\w+(?:\.\w+)+/\S*$")
_ODD_WORD = re.compile(r"[b-df-hj-np-tv-xz]{4,}|\w{21,}|[^\W\d_]+\d\w*|\d+[^\W\d_]\w*")


class _Odd(dict):
    """Whether a word is odd: consonants only, very long, or letters and digits mixed. Emptied when it has grown large."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = _ODD_WORD.fullmatch(word) is not None
        return out


_ODD = _Odd()
_MOJI = re.compile(r"[�\x00-\x08\x0b-\x1f\x7f-\x9f]|Ã.|Â.|â€|Ð.|ï»")
_SEGMENT = 320
#: Runs of letters of scripts written without spaces; two of them are read as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]{3,}")


def _spaced(line: str) -> str:
    return _UNSPACED.sub(lambda m: " ".join(m.group()[k : k + 2] for k in range(0, len(m.group()), 2)), line)


def _reflowed(text: str):
    """Lines with text, runs of five or more lines of one or two words joined: prose may stand one word a line."""
    run: list[str] = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if len(line) < 60 and len(line.split()) <= 2:
            run.append(line)
            continue
        yield from ([" ".join(x.strip() for x in run)] if len(run) > 4 else run)
        run = []
        yield line
    yield from ([" ".join(x.strip() for x in run)] if len(run) > 4 else run)


def segments(text: str) -> list[str]:
    """Lines with text; a line beyond the segment length is cut at white space into several, so no text goes unlabelled."""
    out = []
    for line in _reflowed(text):
        while len(line) > _SEGMENT * 1.5:
            cut = line.rfind(" ", _SEGMENT // 2, _SEGMENT)
            cut = cut if cut > 0 else _SEGMENT
            out.append(line[:cut])
            line = line[cut:]
        if line.strip():
            out.append(line)
    return out


def _bin(x: float, *edges: float) -> int:
    for k, e in enumerate(edges):
        if x <= e:
            return k
    return len(edges)


def observe(line: str, common: frozenset, seen: dict) -> tuple[int, ...]:
    """Line statistics in bins. ``seen`` counts the masked lines of the document so far."""
    line = line.lstrip("> ")
    if not line.isascii():
        line = _spaced(line)
    low = line.lower()
    w = _WORD.findall(low)
    n, solid = len(w), len(line) - line.count(" ")
    letters = sum(map(len, w))
    share = len([x for x in w if x in common]) / n if n else 0.0
    digits = sum(map(len, _DIGIT.findall(line)))
    cells = line.count("\t") + line.count("|")
    commas = line.count(",") + line.count(";")
    shape = 1 if _BULLET.match(line) else 0
    if any(x in line for x in _LEADERS) or cells >= 2 or (cells and n <= 6):
        shape = 2
    elif commas >= 3 and n <= 2.2 * (commas + 1):
        shape = 3
    elif "://" in line or (n < 7 and "@" in line) or _RECORD.match(line.lstrip()):
        shape = 4
    key = " ".join(w)
    again = seen.get(key, 0)
    seen[key] = again + 1
    grams = list(zip(w, w[1:], w[2:]))
    fresh = len([g for g in grams if g not in seen])
    seen.update(dict.fromkeys(grams, 1))
    stale = 1 - fresh / len(grams) if grams else 0.0
    odd = sum(map(_ODD.__getitem__, w)) / n if n else 1.0
    last = line.rstrip(_CLOSING)[-1:]
    return (
        _bin(share, 0, 0.08, 0.2) if share or n < 7 else 4 if n < 12 else 5,
        0 if last in _END else 1 if last in _COMMA else 2,
        _bin(n, 0, 2, 6),
        _bin(digits / max(1, solid), 0.02, 0.12, 0.35),
        _bin((solid - letters) / max(1, solid), 0.06, 0.15, 0.4),
        shape,
        _bin(again, 0, 2),
        _bin(stale, 0.35, 0.75) if n < 8 or len(set(w)) > 0.3 * n else 3 if stale < 0.8 else 4,
        _bin(odd, 0.05, 0.3),
        1 if len(_MOJI.findall(line)) > 2 else 0,
    )


_SIZES = (6, 3, 4, 4, 4, 5, 3, 5, 3, 2)
#: Words of the training lines, of our own choosing; they only need to have the shapes of words.
_NOUNS = "garden lamp river market teacher window bread mountain ticket orange cabinet engine village paper ladder station curtain bottle pianist meadow".split()
_NAMES = "Aldo Berit Corvin Dunya Estel Fabro Gunda Hilmar Isolde Jurek".split()
_FRAMES = (
    "the {0} of the {1} was not in the {2} when they came back, and it is still to be found",
    "we had seen {3} and the {0} before, but no one in the {1} had asked for that",
    "in {4} a {0} with more than {4} parts will be sold to the {1} by {3}",
    "der {0} und die {1} sind nicht mehr in der {2}, aber das ist auch für {3} noch nicht zu sehen",
    "das Haus mit dem {0} wurde von {3} nach der {1} im Jahr {4} an die {2} verkauft",
    "le {0} est dans la {1} et les autres sont avec le {2} de {3} pour une année",
    "après la {0}, {3} a vu un {1} qui était sur le {2} en {4}",
    "el {0} de la {1} no es más que un {2} para los que están con {3}",
    "en {4} la {0} y el {1} se vendieron por {3} a una {2} que ya no era suya",
)


def _examples(rng: random.Random):
    """Labelled documents of all four kinds and of mixtures: (lines, states)."""
    noun, name, num = lambda: rng.choice(_NOUNS), lambda: rng.choice(_NAMES), lambda: str(rng.randint(1, 99999))

    def prose():
        s = [(lambda f: f[0].upper() + f[1:])(rng.choice(_FRAMES).format(noun(), noun(), noun(), name(), num())) + rng.choice(".....?!") for _ in range(rng.randint(2, 9))]
        text = " ".join(s)
        if rng.random() < 0.35:
            width, lines, line = rng.choice((50, 65, 80)), [], ""
            for w in text.split():
                if len(line) + len(w) > width:
                    lines.append(line)
                    line = w
                else:
                    line = f"{line} {w}".strip()
            return [*lines, line]
        if rng.random() < 0.15:
            text = text.lower() if rng.random() < 0.5 else text.replace(".", ";")
        return segments("\n".join(s) if rng.random() < 0.3 else text) + ([f"{name()} {noun()} {noun()}"] if rng.random() < 0.1 else [])

    def items():
        mark = rng.choice(("- ", "* ", "• ", "{}. ", "", "({}) "))
        lines = [mark.format(k + 1) + rng.choice((f"{noun()} {noun()}", f"{name()} {noun()}", f"the {noun()} in {name()}", f"{num()} {noun()}", f"{noun().title()} {noun()} {'.' * rng.randint(4, 30)} {rng.randint(1, 300)}", name())) for k in range(rng.randint(5, 30))]
        if rng.random() < 0.25:
            lines = segments(", ".join(rng.choice((noun(), name())) for _ in range(rng.randint(20, 120))))
        return lines

    def cells():
        sep, k = rng.choice(("\t", " | ", ",", ";", "|")), rng.randint(3, 6)
        cell = lambda: rng.choice((num(), f"{rng.random() * 100:.1f}%", name(), noun(), f"{rng.randint(1, 999)},{rng.randint(100, 999)}" if sep != "," else num(), "n/a", str(rng.randint(1980, 2030))))
        if rng.random() < 0.3:
            return [f'{{"{noun()}": {num()}, "{noun()}": "{name()}"}}' for _ in range(rng.randint(5, 30))]
        return [sep.join(cell() for _ in range(k)) for _ in range(rng.randint(4, 30))]

    def junk():
        letters = "abcdefghijklmnopqrstuvwxyz"
        kind = rng.choice((0, 1, 1, 2, 3, 4, 5))
        if kind == 0:
            return [rng.choice((noun(), f"{noun()} {noun()}", f"the {noun()} of {name()}"))] * rng.randint(8, 40)
        if kind == 1:
            phrase = rng.choice((noun(), f"{name()} {noun()}", f"to the {noun()}", f"a {noun()} and {noun()} {noun()}", f"the {noun()} in {name()}", f"its {noun()} {noun()}", f"some {noun()} of the {noun()} {noun()}"))
            return segments(rng.choice((" ", ", ")).join([phrase] * rng.randint(40, 140)))
        if kind == 2:
            return segments(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 16))) for _ in range(rng.randint(40, 150))))
        if kind == 3:
            return segments("".join(rng.choice("#$%&*+-/<=>?@\\^_|~!: ") for _ in range(rng.randint(100, 700))))
        if kind == 4:
            return segments("\n".join("".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(rng.choice((40, 76)))) for _ in range(rng.randint(3, 20))))
        return rng.choice(([f"https://{name().lower()}{num()}.example/{noun()}/{num()}" for _ in range(rng.randint(6, 40))], segments("".join(rng.choice(("Ã©", "â€™", "Â ", "�", "Ð¡", noun()[:4])) for _ in range(150)))))

    makers = (prose, items, cells, junk)
    for _ in range(900):
        lines, states = [], []
        for _ in range(1 if rng.random() < 0.7 else rng.randint(2, 4)):
            k = rng.choices(range(4), (4, 2, 2, 2))[0]
            part = makers[k]()
            lines += part
            states += [k] * len(part)
        yield lines, states


@lru_cache(maxsize=4)
def fit(common: frozenset, seed: int = 7) -> tuple[list, list, list]:
    """Log probabilities (start, step, line statistics) from counts over generated labelled documents, with add-one smoothing."""
    start = [1.0] * 4
    step = [[1.0] * 4 for _ in range(4)]
    emit = [[[1.0] * size for size in _SIZES] for _ in range(4)]
    for lines, states in _examples(random.Random(seed)):
        seen: dict = {}
        start[states[0]] += 1
        for k, (line, s) in enumerate(zip(lines, states)):
            if k:
                step[states[k - 1]][s] += 1
            for f, v in enumerate(observe(line, common, seen)):
                emit[s][f][v] += 1
    log = lambda row: [math.log(x / sum(row)) for x in row]
    return log(start), [log(r) for r in step], [[log(r) for r in s] for s in emit]


def label(lines: list[str], common: frozenset, model) -> list[int]:
    """The most probable states of the lines (Viterbi)."""
    start, step, emit = model
    seen: dict = {}
    cache: dict = {}
    score, back = None, []
    for line in lines:
        o = observe(line, common, seen)
        e = cache.get(o)
        if e is None:
            e = cache[o] = [sum(emit[s][f][v] for f, v in enumerate(o)) for s in range(4)]
        if score is None:
            score = [a + b for a, b in zip(start, e)]
            continue
        best, frm = [], []
        for s in range(4):
            k = max(range(4), key=lambda r: score[r] + step[r][s])  # noqa: B023
            frm.append(k)
            best.append(score[k] + step[k][s] + e[s])
        back.append(frm)
        score = best
    s = max(range(4), key=score.__getitem__)
    out = [s]
    for frm in reversed(back):
        s = frm[s]
        out.append(s)
    return out[::-1]


_STATS = "id bigint, n_words bigint, mean_word_length double, symbol_ratio double, end_punct_share double, common_share double, distinct_share double, n_lines bigint, prose_share double, list_share double, table_share double, junk_share double"


def describe(text: str, common: frozenset, model) -> tuple:
    """The statistics of one text; shares of lines by their characters. A blank text has no words, lines or shares."""
    lines = segments(text)
    w = _WORD.findall(text.lower())
    if not lines:
        return (0, None, None, None, None, None, 0, None, None, None, None)
    states = label(lines, common, model)
    size = [0, 0, 0, 0]
    for line, s in zip(lines, states):
        size[s] += len(line.strip())
    real = [x for x in text.split("\n") if x.strip()]
    solid = sum(map(len, text.split()))
    letters = sum(map(len, w))
    n, total = len(w), sum(size)
    return (
        n,
        letters / n if n else None,
        (solid - letters) / solid,
        len([x for x in real if x.rstrip(_CLOSING)[-1:] in _END]) / len(real),
        len([x for x in w if x in common]) / n if n else None,
        len(set(w)) / n if n else None,
        len(real),
        *(x / total for x in size),
    )


def text_statistics(df: DataFrame, key: str, text: str, common: set[str]) -> DataFrame:
    """Statistics of every document in one pass, without a shuffle.

    ``common``: function words of the languages to expect, lower-cased, a list of bounded
    size. Columns out: the key, n_words, mean_word_length, symbol_ratio (of characters
    that are no space), end_punct_share (of lines), common_share and distinct_share (of
    words), n_lines, and prose_share, list_share, table_share, junk_share (of characters,
    by the state of their line). Null and blank texts have n_words and n_lines 0 and null
    shares. Rows with a null key are kept, copies too. Lines of any length are labelled
    whole, in segments.
    """
    known = df.sparkSession.sparkContext.broadcast((frozenset(common), fit(frozenset(common))))

    def run(batches):
        import pyarrow as pa

        words, model = known.value
        for b in batches:
            rows = [(i, *describe(t or "", words, model)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*rows)) if rows else [()] * 12
            names = [x.split()[0] for x in _STATS.split(", ")]
            types = [pa.int64() if x.endswith("bigint") else pa.float64() for x in _STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    out = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _STATS)
    return out.withColumnRenamed("id", key)


def not_prose(stats: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents with text of which less than ``least`` is labelled prose."""
    return stats.where((F.col("n_lines") > 0) & (F.col("prose_share") < least))
