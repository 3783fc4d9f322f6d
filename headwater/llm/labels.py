"""Labels in one spelling: sources, languages and web domains, and the language a text is written in."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """A label without case, white space and punctuation; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def domain_name(c: Column) -> Column:
    """Host in lower case without scheme, port, path and leading www.; null if empty."""
    host = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"[/:?#].*$", ""), r"^www\d*\.", ""), F.lit(""))


# Frequent function words of each language written in Latin letters.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine einen mit von zu den dem des im auf für als auch sich es wird werden bei aus nach durch über wenn weil während jede jeder jedes",
    "en": "the of and to in is that it was for with as on are by be this from at or an have not which each we you they before after while because since",
    "es": "el la los las de que y en un una por con para es se del al lo como más pero sus este esta si cuando porque aunque cada sobre entre luego",
    "fr": "le la les de des et un une est que qui dans en du pour par sur au aux avec ne pas plus ce cette ou mais si chaque quand lorsque puis",
}
# Endings that tell these languages apart where a text has hardly any function word.
ENDINGS = {"de": "ung keit heit lich isch schaft", "en": "tion ing ity ness ed ly ous al", "es": "ción dad mente aje ado ada", "fr": "ité eux euse eur ique ement"}
ENDINGS = {k: tuple(v.split()) for k, v in ENDINGS.items()}
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-鿿]")
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_BY_WORD: dict[str, list[str]] = {}
for _lang, _text in FUNCTION_WORDS.items():
    for _w in _text.split():
        _BY_WORD.setdefault(_w, []).append(_lang)


def language_of(text: str | None, words: list[str] | None = None) -> str | None:
    """Language of the whole text: by script, else by its function words, else by endings; None if nothing decides.

    words are its words in any case, where the caller has them already.
    """
    if not text:
        return None
    counts = Counter(words if words is not None else _LATIN_WORD.findall(text))
    if not text.isascii():
        kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
        # One such sign says about as much as three Latin letters.
        if kana + han and (kana + han) * 3 > sum(len(w) * n for w, n in counts.items()) - kana - han:
            return "ja" if kana * 10 >= kana + han else "zh"
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    get = counts.get
    for w, langs in _BY_WORD.items():
        if n := get(w, 0) + get(w.capitalize(), 0) + get(w.upper(), 0) * (len(w) > 1):
            for lang in langs:
                score[lang] += n / len(langs)
    if sum(score.values()) * 20 < sum(counts.values()):
        lower = [(w.lower(), n) for w, n in counts.items()]
        for lang, ends in ENDINGS.items():
            score[lang] += 0.5 * sum(n for w, n in lower if w.endswith(ends))
    best = max(sorted(score), key=lambda k: score[k])
    return best if score[best] > 0 else None


# The first letters of a language label and the language they mean.
LANGUAGE_LABELS = {
    "ger": "de", "deu": "de", "german": "de", "deutsch": "de", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr",
    "french": "fr", "jpn": "ja", "japanese": "ja", "chi": "zh", "zho": "zh", "chinese": "zh", "de": "de", "en": "en", "es": "es", "fr": "fr", "ja": "ja", "zh": "zh",
}


def language_label(label: str | None) -> str | None:
    """The two-letter language a label means; None if unknown."""
    head = re.split(r"[-_\s]", (label or "").strip().lower())[0]
    return LANGUAGE_LABELS.get(head)


def language_label_column(c: Column) -> Column:
    """language_label as a native column."""
    head = F.get(F.split(F.trim(F.lower(c)), r"[-_\s]"), F.lit(0))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_LABELS.items() for x in kv]), head)
