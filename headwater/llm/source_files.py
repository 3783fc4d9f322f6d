"""Generated, minified, vendored and data files among source code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.session import cut

# Folders that hold what tools write, and what other projects wrote.
GENERATED_DIRS = frozenset("gen generated __generated__ _generated autogen auto_generated autogenerated generated-sources generated_src codegen".split())
VENDORED_DIRS = frozenset(
    "vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd-party 3rd_party node_modules bower_components jspm_components web_modules external externals extern deps godeps _vendor pods carthage".split()
)
#: Folders whose subfolders are named after a project.
PROJECT_ROOTS = frozenset("src lib libs pkg pkgs packages components modules contrib ext".split())
_GENERATED_NAME = re.compile(r"(?:[._-](?:generated|autogen|gen|designer|pb)\.[a-z0-9]+|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|c)|\.g\.(?:cs|dart))$", re.I)
_MIN_NAME = re.compile(r"[._-]min\.(?:js|mjs|css)$", re.I)
# How tools mark what they wrote, and how people mark what they took over.
_GENERATED_MARK = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto(?:matically)?[- ]?generated\b|\bgenerated (?:code|file|by|from)\b|\bgenerated (?:on )?\d{4}-\d\d-\d\d\b|\bdo not (?:edit|modify)\b.{0,80}\bgenerated\b"
    r"|\b(?:built|produced|created|emitted|written) by the \S+ (?:compiler|generator|tool)\b|\bautomatically (?:produced|created|written)\b|\bedit the \S+ instead\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bg[ée]n[ée]r[ée]e? (?:par|automatiquement)\b|\bgenerado (?:por|autom[áa]ticamente)\b|自動生成|自动生成",
    re.I,
)
_VENDORED_MARK = re.compile(
    r"\bvendored (?:copy|from|version)\b|\bcopied (?:into this tree|verbatim|unchanged|unmodified|from https?:)|\b(?:taken|imported|copied|borrowed) (?:verbatim|unchanged|unmodified|as is) from\b"
    r"|\bsend (?:patches|fixes|changes) upstream\b|\bupstream: ?https?:",
    re.I,
)
_COMMENT = re.compile(r"\s*(?://|#(?!include|define|pragma|if|endif)|/\*|\*|--|;|<!--|\"\"\"|\'\'\'|%|REM\b)")
_BANNER_GAP = re.compile(r"\s*(?:$|#!|<\?xml|['\"]use strict['\"];?$|package\s|---)")
_NAME = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|([A-Za-z_$][A-Za-z0-9_$]*)")
_NUMBERS = re.compile(r"(?:(?<![\w.])[-+]?(?:0[xX][0-9A-Fa-f]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*\s*[,;]?\s*){6,}")
_PAIRS = re.compile(r"\"[^\"\n]*\"\s*:\s*(?:-?[\d.]+(?:[eE][-+]?\d+)?|\"[^\"\n]*\"|true|false|null)[,{}\[\]\s]*")
_BLOB = re.compile(r"[A-Za-z0-9+/=\\-]{40,}")
_DIGITS, _SPACE = b"0123456789", b" \t\r\n\f\v"
_PROSE_EXT = frozenset("md markdown mdx rst txt adoc org".split())
# The language a file ending stands for where the label is missing.
EXT_LANG = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c", "css": "css", "sh": "shell", "ini": "ini", "cfg": "ini", "rb": "ruby", "rs": "rust", "php": "php"}
_ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_$")}
_SIDE = len(_ALPHABET) + 1  # 0 is either end
#: Pairs after each character that the model of all languages counts for in the model of one.
_PRIOR = 20
#: Part of the hand-written files of a language whose names cost less than mangled ones do, names that a
#: file needs to be scored, and scored files that a language needs for a bound of its own.
_WRITTEN, _LEAST_NAMES, _LEAST_FILES = 0.95, 8, 50
#: The same part where names are very short as well, which two signs together decide.
_USUAL, _SHORT_NAME = 0.75, 4.0
#: Bits by which the file's own naming style must explain its names better than the style of the rest of its repository.
_FOREIGN_BITS = 24.0


def language(label: str | None, path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if ext in _PROSE_EXT:
        return "markdown"
    return EXT_LANG.get(ext) or (label or "").strip().lower() or "other"


def identifiers(text: str) -> list[str]:
    """Names in the code, outside string literals."""
    return [x for x in _NAME.findall(text) if x]


_CODE_OF = np.zeros(256, np.int64)
for _c, _i in _ALPHABET.items():
    _CODE_OF[ord(_c)] = _CODE_OF[ord(_c.upper())] = _i


def bigrams(names: list[str]) -> np.ndarray:
    """Pair codes of neighbouring characters of all names, ends included."""
    if not names:
        return np.empty(0, np.int64)
    codes = _CODE_OF[np.frombuffer((" " + " ".join(names) + " ").encode("ascii"), np.uint8)]
    return codes[:-1] * _SIDE + codes[1:]


def shape(text: str) -> tuple[int, int, float, int]:
    """(bytes, solid bytes, share of blanks, longest line)."""
    raw = text.encode("utf-8", "surrogatepass")
    solid = len(raw.translate(None, _SPACE))
    return len(raw), solid, 1 - solid / max(1, len(raw)), max(map(len, text.split("\n")))


def is_dense(longest_line: int, blank_share: float) -> bool:
    return longest_line >= 250 and blank_share <= 0.08


def _count_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each pair of characters stands in the names of each language, each name
    once a file.  Dense files and those whose path says that nobody wrote them here are left out."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        names: dict[str, list[str]] = {}
        for label, path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            lang = language(label, path)
            if lang != "markdown" and not by_path(path):
                text = text.as_py()
                _, _, blanks, longest = shape(text)
                if is_dense(longest, blanks):
                    continue
                own = set(_NAME.findall(text))
                own.discard("")
                names.setdefault(lang, []).extend(own)
        for lang, listed in names.items():
            got = total.setdefault(lang, np.zeros(_SIDE * _SIDE, np.int64))
            got += np.bincount(bigrams(listed), minlength=_SIDE * _SIDE)
    for lang, counts in total.items():
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "pair", "n"])


def name_models(files: DataFrame, *, most_languages: int = 64) -> dict[str, np.ndarray]:
    """Bits of each pair of characters given its first, per language, from the names of hand-written files.

    At most most_languages languages, those with the most pairs, get a model of their own, and all
    together make the model ``*`` that serves the others: at most (most_languages + 1) * 39 ** 2 rows
    reach the driver.  A model of few names leans on ``*``.
    """
    counted = files.select("code_lang", "path", "content").where(F.col("content").isNotNull()).mapInArrow(_count_names, "lang string, pair int, n long")
    counted = cut(counted.groupBy("lang", "pair").agg(F.sum("n").alias("n")))
    top = [r[0] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()]
    rows = counted.withColumn("lang", F.when(F.col("lang").isin(top), F.col("lang")).otherwise("*")).groupBy("lang", "pair").agg(F.sum("n").alias("n")).collect()
    tables: dict[str, np.ndarray] = {"*": np.zeros(_SIDE * _SIDE)}
    for lang, pair, n in rows:
        tables.setdefault(lang, np.zeros(_SIDE * _SIDE))[pair] += n
        if lang != "*":
            tables["*"][pair] += n
    out = {}
    every = (tables["*"] + 0.5).reshape(_SIDE, _SIDE)
    every /= every.sum(axis=1, keepdims=True)
    for lang, t in tables.items():
        t = every if lang == "*" else t.reshape(_SIDE, _SIDE) + _PRIOR * every
        out[lang] = -np.log2(t / t.sum(axis=1, keepdims=True)).ravel()
    return out


def head_comments(lines: list[str]) -> str:
    """The comments before the first line of code, one string, however many lines they take."""
    out, block = [], False
    for line in lines:
        bare = line.strip()
        if block or _COMMENT.match(line):
            out.append(bare)
            if bare.startswith(("/*", "<!--")):
                block = True
            if "*/" in bare or "-->" in bare:
                block = False
        elif not _BANNER_GAP.match(line):
            break
    return "\n".join(out)


def literal_share(text: str, solid: int) -> float:
    """Share of the solid characters that long runs of numbers, blobs and rows of literal fields make up."""
    squeezed = lambda s: len(s) - sum(map(str.isspace, s))
    taken = sum(squeezed(m.group()) for m in _NUMBERS.finditer(text))
    rest = _NUMBERS.sub(" ", text)
    rows = [m.group() for m in _PAIRS.finditer(rest)]
    if len(rows) >= 12:
        taken += sum(map(squeezed, rows))
        rest = _PAIRS.sub(" ", rest)
    taken += sum(len(m.group()) for m in _BLOB.finditer(rest) if any(c.isdigit() for c in m.group()) and any(c.isupper() for c in m.group()))
    return min(1.0, taken / max(1, solid))


def stem_diversity(names: list[str]) -> float:
    """Distinct stems (names without digits) for each name that holds digits; 1 if there are few."""
    numbered = [re.sub(r"\d+", "0", n) for n in names if any(c.isdigit() for c in n)]
    if len(numbered) < 8 or len(numbered) * 2 < len(names):
        return 1.0
    return len(set(numbered)) / len(numbered)


def style(names: list[str]) -> tuple[int, int]:
    """Of the distinct names of more than one part: those in snake_case, and those in camelCase."""
    snake = sum("_" in n.strip("_") for n in names)
    camel = sum("_" not in n and n != n.lower() and n != n.upper() for n in names)
    return snake, camel


def by_path(path: str | None) -> list[str]:
    """What folders and the file's name alone say."""
    parts = [x for x in (path or "").replace("\\", "/").lower().split("/") if x]
    dirs, name = set(parts[:-1]), parts[-1] if parts else ""
    found = (("generated", dirs & GENERATED_DIRS or _GENERATED_NAME.search(name)), ("minified", _MIN_NAME.search(name)), ("vendored", dirs & VENDORED_DIRS))
    return [kind for kind, said in found if said]


def examine(text: str, bits: np.ndarray, prose: bool = False) -> dict:
    """Measures of one file.  Literals are gone through only where cheap counts leave a
    question: files with few digits and no blob are no data.
    entropy: mean bits of a pair of characters in the distinct names; 0 in prose and without names."""
    size, solid, blanks, longest = shape(text)
    raw = text.encode("utf-8", "surrogatepass")
    digits = size - len(raw.translate(None, _DIGITS))
    head = head_comments(text.split("\n"))
    m = {
        "marked": bool(head) and _GENERATED_MARK.search(head) is not None, "taken": bool(head) and _VENDORED_MARK.search(head) is not None,
        "longest_line": longest, "blank_share": blanks, "entropy": 0.0, "name_length": 99.0, "n_names": 0, "diversity": 1.0, "literals": 0.0, "snake": 0, "camel": 0,
    }
    literal = digits > 0.1 * solid or _BLOB.search(text) is not None
    if literal:
        m["literals"] = literal_share(text, solid)
    names = [] if prose else identifiers(text)
    own = sorted(set(names))
    if own:
        snake, camel = style(own)
        m |= {"entropy": float(bits[bigrams(own)].mean()), "name_length": sum(map(len, names)) / len(names), "n_names": len(own), "diversity": stem_diversity(names), "snake": snake, "camel": camel}
    return m


def kinds_of(path: str | None, m: dict, lang: str) -> list[str]:
    """What the path and the measures say, without regard to other projects' names and to what names cost and look like elsewhere."""
    said, prose = by_path(path), lang == "markdown"
    out = []
    if m["marked"] or "generated" in said or (not prose and m["diversity"] <= 0.25):
        out.append("generated")
    if not prose and "minified" in said:
        out.append("minified")
    if "vendored" in said or m["taken"]:
        out.append("vendored")
    if not prose and lang != "ini" and m["literals"] >= 0.6:
        out.append("data")
    return out


def may_be_minified(m: dict) -> bool:
    """Dense and no data: minified if its names are mangled."""
    return is_dense(m["longest_line"], m["blank_share"]) and m["literals"] < 0.5


_MEASURES = {"entropy": "double", "name_length": "double", "diversity": "double", "literals": "double", "n_names": "int", "snake": "int", "camel": "int"}
_SEEN = "file_id long, repo_name string, projects array<string>, lang string, kinds array<string>, " + ", ".join(f"{k} {v}" for k, v in _MEASURES.items()) + ", model string, dense boolean"


def _examine_rows(models: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_list = pa.list_(pa.string())
        types = [pa.int64(), pa.string(), text_list, pa.string(), text_list, *(pa.float64() if v == "double" else pa.int32() for v in _MEASURES.values()), pa.string(), pa.bool_()]
        names = ["file_id", "repo_name", "projects", "lang", "kinds", *_MEASURES, "model", "dense"]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for fid, repo, path, label, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                lang = language(label, path)
                model, prose = lang if lang in models else "*", lang == "markdown"
                m = examine(text or "", models[model], prose)
                parts = [x for x in (path or "").replace("\\", "/").lower().split("/") if x]
                own = (repo or "").strip().strip("/").lower().rsplit("/", 1)[-1] or None
                inside = {y for x, y in zip(parts[:-2], parts[1:-1]) if x in PROJECT_ROOTS and y != own} if own and not prose else ()
                row = (fid, own, sorted(inside), lang, kinds_of(path, m, lang), *(m[k] for k in _MEASURES), model, not prose and may_be_minified(m))
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def mangled(seen: DataFrame) -> DataFrame:
    """seen with minified among the kinds of dense files whose names cost more than hand-written ones of their language.

    The bounds are quantiles of the scores of files without a kind that aren't dense; languages with
    few of them share one.  A file is minified above the higher bound, and above the lower one if its
    names are very short as well; a corpus too small for any bound leaves it to the latter.  At most one row per model, so they are joined by broadcast.
    """
    written = seen.where(~F.col("dense") & (F.size("kinds") == 0) & (F.col("n_names") >= _LEAST_NAMES))
    bound = F.percentile_approx("entropy", [_WRITTEN, _USUAL], 10_000).alias
    own = written.groupBy("model").agg(bound("own"), F.count("*").alias("n")).where(F.col("n") >= _LEAST_FILES).select("model", "own")
    all_ = written.agg(bound("every"), F.count("*").alias("n")).select(F.when(F.col("n") >= _LEAST_FILES, F.col("every")).alias("every"))
    scored = seen.join(F.broadcast(own), "model", "left").crossJoin(F.broadcast(all_)).withColumn("own", F.coalesce("own", "every"))
    costly = F.coalesce(F.col("entropy") > F.get("own", F.lit(0)), F.lit(False)) | ((F.col("name_length") <= _SHORT_NAME) & F.coalesce(F.col("entropy") > F.get("own", F.lit(1)), F.lit(True)))
    return scored.withColumn("kinds", F.when(F.coalesce(F.col("dense") & costly, F.lit(False)), F.array_union("kinds", F.array(F.lit("minified")))).otherwise(F.col("kinds"))).drop("model", "dense", "own", "every")


def foreign_style(seen: DataFrame) -> DataFrame:
    """seen with vendored among the kinds of files whose names are in a style foreign to their repository.

    Per repository and language the shares of snake_case and camelCase of the other files without a kind
    are compared with the file's own: bits that the file's own shares save over theirs.  Repositories
    are aggregated before they are joined; a repository of one such file, or none, has no style.
    """
    plain = F.size("kinds") == 0
    styles = seen.where(plain & F.col("repo_name").isNotNull()).groupBy("repo_name", "lang").agg(F.sum("snake").alias("all_snake"), F.sum("camel").alias("all_camel"), F.count("*").alias("files"))
    at = seen.join(styles, ["repo_name", "lang"], "left")
    less = lambda c: F.col(f"all_{c}") - F.when(plain, F.col(c)).otherwise(F.lit(0)) + 0.5
    rest, own = less("snake") + less("camel"), F.col("snake") + F.col("camel")
    bits = lambda c: F.when(F.col(c) > 0, F.col(c) * (F.log2(F.col(c) / own) - F.log2(less(c) / rest))).otherwise(F.lit(0.0))
    foreign = F.coalesce((F.col("files") >= 2) & (own > 0) & (F.col("lang") != "markdown") & (bits("snake") + bits("camel") >= _FOREIGN_BITS) & plain, F.lit(False))
    return at.withColumn("kinds", F.when(foreign, F.array(F.lit("vendored"))).otherwise(F.col("kinds"))).drop("all_snake", "all_camel", "files")


def classify_files(files: DataFrame) -> DataFrame:
    """(file_id, lang, kinds, entropy, name_length, diversity, literals): one row per file_id.

    kinds: of generated, minified, vendored, data; empty for hand-written files.  A file is vendored
    if it lies in a folder for foreign code, or in a folder of a source root that is named after
    another repository of the corpus than its own, or if its names are in a style foreign to the rest
    of its repository.  Deliveries of one file_id are one file: what any
    of them shows counts.  Null contents leave path and repo to decide, a null path the content;
    without a repo no folder is foreign.  Rows with a null file_id are left out; extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = files.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", "code_lang", "content")
    models = name_models(rows)
    seen = foreign_style(mangled(cut(rows.mapInArrow(_examine_rows(models), _SEEN))))
    projects = rows.select(F.regexp_extract(F.lower(F.trim("repo")), r"([^/]+)/*$", 1).alias("project")).where("project != ''").distinct()
    flat = seen.select("file_id", "lang", "kinds", "entropy", "name_length", "diversity", "literals", F.explode_outer("projects").alias("project"))
    other = flat.where(F.col("project").isNotNull()).select("file_id", "project").distinct().join(projects, "project", "left_semi").select("file_id").distinct()
    first = ["lang", "entropy", "name_length", "diversity", "literals"]
    one = flat.groupBy("file_id").agg(*(F.max(c).alias(c) for c in first), *(F.max(F.array_contains("kinds", k)).alias(k) for k in ("generated", "minified", "vendored", "data")))
    one = one.join(other.withColumn("foreign", F.lit(True)), "file_id", "left").withColumn("vendored", F.col("vendored") | F.coalesce("foreign", F.lit(False)))
    kinds = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("generated", "minified", "vendored", "data"))))
    return one.select("file_id", "lang", kinds.alias("kinds"), "entropy", "name_length", "diversity", "literals")
