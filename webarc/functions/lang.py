"""Fast language detection: a text's n-gram counts in a few bins, compared with the profiles of languages.

Profiles are trained from labelled texts (operators.lang_jobs); a small set from one paragraph a language is built in.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BINS, CUTOFF, LONGEST = 256, 1200, 5
UNKNOWN = ("unknown", 0)
_SPACE = np.zeros(0x110000, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


#: Texts are counted in groups of about so many characters, whose arrays stay in the processor's cache.
GROUP = 1 << 16


def text_vectors(texts: list[str | None], bins: int = BINS) -> np.ndarray:
    """A row of bins for each text: counts of 1- to 5-grams of letters and single blanks, by a folded FNV-1a hash over code points, times 256 by the number of characters, 255 at most."""
    texts = [t or "" for t in texts]
    ends = np.cumsum([len(t) for t in texts]) // GROUP if texts else np.zeros(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return np.concatenate([_vectors(texts[a:b], bins) for a, b in zip(cuts, cuts[1:], strict=False)])


def _vectors(texts: list[str], bins: int) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    alpha = _letters()[points]
    space = _SPACE[points] & ~alpha
    behind_space = np.zeros(len(points), bool)
    if len(points):
        behind_space[1:] = space[:-1] & (row[1:] == row[:-1])
    keep = alpha | (space & ~behind_space)
    points, row = np.where(space, np.uint32(32), points)[keep], row[keep]
    n = np.bincount(row, minlength=len(texts))
    counts = np.zeros(len(texts) * bins, np.int64)
    with np.errstate(over="ignore"):
        for size in range(1, LONGEST + 1):
            m = len(points) - size + 1
            if m <= 0:
                break
            h = np.full(m, 0x811C9DC5, np.uint32)
            for k in range(size):
                h = (h ^ points[k : k + m]) * np.uint32(0x01000193)
            b = ((h >> np.uint32(8)) ^ h) & np.uint32(0xFF)
            whole = row[:m] == row[size - 1 :]
            counts += np.bincount(row[:m][whole] * bins + (b[whole] % bins if bins < 256 else b[whole]), minlength=len(counts))
    counts = counts.reshape(len(texts), bins)
    return np.minimum(255, counts * 256 // np.maximum(n, 1)[:, None]).astype(np.uint8)


def rank_languages(vectors: np.ndarray, lengths: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Distances of texts to profiles; short texts far from a profile pay for its place in the list, which holds the most spoken languages first."""
    out = np.zeros((len(vectors), len(profiles)), np.int64)
    for k, p in enumerate(profiles.astype(np.int16)):
        out[:, k] = np.abs(vectors.astype(np.int16) - p[None, :]).sum(1, dtype=np.int64)
    short = (out > 500) & (lengths < 150)[:, None]
    return out + short * np.minimum(50, 3 * np.arange(len(profiles)))[None, :]


def detect_many(texts: list[str | None], labels: list[str], profiles: np.ndarray, cutoff: int = CUTOFF, n_results: int = 1, langs: list[str] | None = None) -> list[list[tuple[str, int]]]:
    """For each text its nearest languages with their distances, at most n_results; none beyond the cutoff. langs restricts them; [] leaves none."""
    ranks = rank_languages(text_vectors(texts), np.array([len(t or "") for t in texts]), profiles)
    allowed = np.array([langs is None or x in langs for x in labels], bool)
    ranks = np.where((ranks <= cutoff) & allowed[None, :], ranks, np.iinfo(np.int64).max)
    order = np.argsort(ranks, axis=1, kind="stable")[:, : max(n_results, 0)]
    return [[(labels[k], int(r[k])) for k in o if r[k] <= cutoff] for r, o in zip(ranks, order, strict=True)]


def detect_fast(text: str, cutoff: int = CUTOFF, n_results: int = 1, langs: list[str] | None = None, profiles: dict[str, list[int]] | None = None):
    """(language, rank), or a list of them if n_results isn't 1; ("unknown", 0) if none is near enough."""
    profiles = built_in() if profiles is None else profiles
    got = detect_many([text], list(profiles), np.array(list(profiles.values()), np.uint8), cutoff, n_results, langs)[0]
    return (got[0] if got else UNKNOWN) if n_results == 1 else got


def train_profile(texts: list[str], bins: int = BINS) -> list[int]:
    """The whole mean of the texts' vectors."""
    return (text_vectors(texts, bins).astype(np.int64).sum(0) // max(len(texts), 1)).clip(0, 255).tolist() if texts else [0] * bins


def language(text: Column | str, profiles: dict[str, list[int]] | None = None, cutoff: int = CUTOFF, langs: list[str] | None = None) -> Column:
    """STRUCT<lang, rank>; NULL texts give NULL."""
    profiles = built_in() if profiles is None else profiles
    labels, table = list(profiles), np.array(list(profiles.values()), np.uint8)

    @F.pandas_udf("struct<lang:string,rank:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [g[0] if g else UNKNOWN for g in detect_many(s.tolist(), labels, table, cutoff, 1, langs)]
        return pd.DataFrame(got, columns=["lang", "rank"])

    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), run(c))


def languages(text: Column | str, n_results: int, profiles: dict[str, list[int]] | None = None, cutoff: int = CUTOFF, langs: list[str] | None = None) -> Column:
    """ARRAY<STRUCT<lang, rank>>, nearest first."""
    profiles = built_in() if profiles is None else profiles
    labels, table = list(profiles), np.array(list(profiles.values()), np.uint8)

    @F.arrow_udf("array<struct<lang:string,rank:int>>")
    def run(s: pa.Array) -> pa.Array:
        got = detect_many(s.to_pylist(), labels, table, cutoff, n_results, langs)
        return pa.array([[{"lang": a, "rank": b} for a, b in g] for g in got], pa.list_(pa.struct([("lang", pa.string()), ("rank", pa.int32())])))

    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), run(c))


def text_vector(text: Column | str, bins: int = BINS) -> Column:
    @F.arrow_udf("array<int>")
    def run(s: pa.Array) -> pa.Array:
        v = text_vectors(s.to_pylist(), bins)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * bins), pa.array(v.astype(np.int32).ravel()))

    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), run(c))


def supported_langs(profiles: dict[str, list[int]] | None = None) -> list[str]:
    return sorted(built_in() if profiles is None else profiles)


def supported_langs_table(spark: SparkSession):
    return spark.createDataFrame([(x,) for x in supported_langs()], "lang string")


#: A paragraph a language, by number of speakers: the first article of the Universal Declaration of Human Rights.
_PARAGRAPHS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "ja": "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
}


@lru_cache(1)
def built_in() -> dict[str, list[int]]:
    return {k: train_profile([v]) for k, v in _PARAGRAPHS.items()}
