"""Column expressions over text. All of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What str.strip() and \s treat as white space, as characters and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Where str.splitlines() breaks a line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Languages by suffix and by exact file name.
PYTHON_SUFFIX = ".py"
SPECIAL_NAMES = {
    "Dockerfile": "dockerfile",
    "requirements.txt": "requirements",
    "environment.yml": "yaml",
    "environment.yaml": "yaml",
    "pyproject.toml": "toml",
    "README.md": "markdown",
}
SUFFIXES = {
    ".ipynb": "ipynb",
    ".md": "markdown",
    ".txt": "text",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".json": "json",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".conf": "ini",
}
UNKNOWN_LANG = "unknown"

# Limits on what is embedded and kept, for those who ask for them. Nothing is cut by default.
MIN_EMBED_CHARS = 120
MAX_BODY_CHARS = 1500
SNIPPET_CHARS = 8000

# Word characters are spelled out because Java's ``\\w`` and ``\\b`` count others.
_WORD = r"[\p{L}\p{N}_]"
# Stands at both ends of every run of word characters; where a text has it itself, it is another private character.
_MARK, _UNMARKED = "\ue000", "\ue001"


def _folds() -> tuple[str, str]:
    """Lower-case characters that are the same but for case as another one, and that one."""

    def turned(c: str, by) -> str:
        return by(c) if len(by(c)) == 1 else c

    pairs = [(c, turned(turned(c, str.upper), str.lower)) for c in map(chr, range(0x20000)) if c.lower() == c]
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


_FOLDED, _FOLDS = _folds()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Strip Unicode white space on both ends (``trim`` alone only strips blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def text_hash(c: Column) -> Column:
    """sha256 hex of the UTF-8 text; NULL hashes like the empty text."""
    return F.sha2(text_or_empty(c), 256)


def first_chars(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all."""
    return text_or_empty(c) if n is None else F.substring(text_or_empty(c), 1, n)


def join_nonempty(sep: str, *parts: Column) -> Column:
    """Join the parts that are neither NULL nor empty (``concat_ws`` keeps empty ones)."""
    return F.array_join(F.filter(F.array(*[text_or_empty(p) for p in parts]), lambda x: x != ""), sep)


def symbol_text(name: Column, kind: Column, doc: Column, source: Column, max_body: int | None = None) -> Column:
    """What is embedded for a symbol: kind, name, docstring and its body (or the head of it), one per line."""
    return strip(join_nonempty("\n", kind, name, doc, first_chars(source, max_body)))


def pattern_text(name: Column, description: Column, motivation: Column, solution: Column) -> Column:
    """What is embedded for a pattern (the batch order, which is the effective one)."""
    return strip(join_nonempty(" | ", name, description, motivation, solution))


def pattern_load_text(name: Column, description: Column, motivation: Column, solution: Column) -> Column:
    """The pattern text in the order used while the catalogue is being loaded."""
    return join_nonempty(" | ", description, motivation, solution, name)


def clean_pattern_name(c: Column) -> Column:
    """Drop footnote marks such as ``[12a]`` or ``(3)``, collapse runs of white space, strip."""
    no_notes = F.regexp_replace(strip(c), rf"[\[(]{SPACE_CLASS}*\p{{Nd}}+[a-zA-Z]*{SPACE_CLASS}*[\])]", "")
    return strip(F.regexp_replace(no_notes, SPACE_CLASS + "{2,}", " "))


def repo_name(url: Column) -> Column:
    """Last path segment of the URL without any ``.git``."""
    return F.replace(F.substring_index(F.rtrim(url, F.lit("/")), "/", -1), F.lit(".git"), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def detect_lang(path: Column) -> Column:
    """Language of a path: ``.py`` suffix, then exact name, then suffix, else ``unknown``."""
    name = file_name(path)

    def has_suffix(s: str) -> Column:
        # a name that is nothing but the suffix has no suffix
        return name.endswith(s) & (F.length(name) > len(s))

    lang = F.when(has_suffix(PYTHON_SUFFIX), "python")
    for special, value in SPECIAL_NAMES.items():
        lang = lang.when(name == special, value)
    for suffix, value in SUFFIXES.items():
        lang = lang.when(has_suffix(suffix), value)
    return lang.otherwise(UNKNOWN_LANG)


def outside_git_dir(rel_path: Column) -> Column:
    """True unless some component of the path is exactly ``.git``."""
    return ~F.array_contains(F.split(rel_path, "/"), ".git")


def relative_path(path: Column, root: Column) -> Column:
    """``path`` without its ``root`` prefix."""
    base = F.rtrim(root, F.lit("/"))
    return F.substr(path, F.length(base) + 2)


def long_enough(doc: Column, source: Column, min_chars: int) -> Column:
    """Docstring and body together reach ``min_chars`` characters."""
    return F.length(text_or_empty(doc)) + F.length(text_or_empty(source)) >= F.lit(min_chars)


def decode_utf8(content: Column) -> Column:
    """Decode bytes as UTF-8, drop invalid bytes, fold CRLF and CR to LF.

    A replacement character that is really in the text is set aside while the invalid bytes are
    replaced and dropped, so that it survives.
    """
    aside = F.lit("\ufdd0\ufdd1\ufdd0")
    replacement = F.lit("\ufffd")
    raw = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(F.replace(raw, replacement, aside)), replacement, F.lit(""))
    valid = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(repaired, aside, replacement))
    return F.replace(F.replace(valid, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def line_slice(source: Column, lineno: Column, end_lineno: Column) -> Column:
    """Lines ``lineno`` to ``end_lineno`` (1-based, inclusive, clamped); '' when a bound is NULL or 0."""
    pieces = F.split(text_or_empty(source), LINE_BREAK, -1)
    # a final line break ends the last line and opens no new one
    n_lines = F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    first = F.greatest(lineno, F.lit(1))
    count = F.least(end_lineno, n_lines) - first + 1
    usable = (F.coalesce(lineno, F.lit(0)) != 0) & (F.coalesce(end_lineno, F.lit(0)) != 0) & (count > 0)
    return F.when(usable, F.array_join(F.slice(pieces, first, F.greatest(count, F.lit(0))), "\n")).otherwise("")


def json_strings(c: Column) -> Column:
    """JSON array of strings; NULL, empty, malformed or not an array gives an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def keyword_text(name: Column, doc: Column) -> Column:
    """The text a keyword is looked for in (the body is not searched)."""
    return F.concat(text_or_empty(name), F.lit(" "), text_or_empty(doc))


def gate_text(name: Column, doc: Column, source: Column) -> Column:
    return F.concat(text_or_empty(name), F.lit(" "), text_or_empty(doc), F.lit(" "), text_or_empty(source))


def contains_keyword(text: Column, keyword: Column) -> Column:
    """Case-insensitive substring test; an empty keyword never matches."""
    return (keyword != "") & F.contains(F.lower(text), F.lower(keyword))


def folded(text: Column) -> Column:
    """Texts that are equal but for case, one character for one, become equal."""

    def turned(low: Column) -> Column:
        rare = reduce(Column.__or__, [F.contains(low, F.lit(c)) for c in _FOLDED])
        return F.when(rare, F.translate(low, _FOLDED, _FOLDS)).otherwise(low)

    # a lambda's argument is evaluated once, not once for each use
    return F.get(F.transform(F.array(F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))), turned), F.lit(0))


def _marked(low: Column) -> Column:
    """A folded text with a mark at every boundary between word characters and others."""
    own = F.replace(low, F.lit(_MARK), F.lit(_UNMARKED))
    return F.regexp_replace(own, F.lit(f"{_WORD}+"), F.lit(f"{_MARK}$0{_MARK}"))


# Where a mark stands for a word: what must be beside it, by whether the word begins and ends with a word character. Beside
# another mark is the end or the beginning of the same word.
_WITH_MARK = f"[{_WORD[1:-1]}{_MARK}]"
_ALONE = {
    (True, True): (f"(?<!{_WITH_MARK}{_MARK})", f"(?!{_WITH_MARK})"),
    (True, False): (f"(?<!{_WORD}{_MARK})", f"(?={_WITH_MARK})"),
    (False, True): (f"(?<={_WITH_MARK}{_MARK})", f"(?!{_WORD})"),
    (False, False): (f"(?<={_WORD}{_MARK})", f"(?={_WORD})"),
}


def _stands_alone(low: Column, word: Column) -> Column:
    """Whether a folded word is somewhere in a folded text between boundaries.

    Its places are replaced by a mark, and a constant pattern looks beside the marks. Where a word may overlap itself, a place can be
    missed; then the boundaries of both are marked, and the word with a mark at either end is a plain
    substring: a boundary inside it is one in the text as well.
    """
    begins, ends = (F.rlike(c, F.lit(_WORD)) for c in (F.substring(word, 1, 1), F.right(word, F.lit(1))))

    def beside(replaced: Column) -> Column:
        tests = {k: F.rlike(replaced, F.lit(f"{_MARK}{left}{right}")) for k, (left, right) in _ALONE.items()}
        return F.when(begins & ends, tests[True, True]).when(begins, tests[True, False]).when(ends, tests[False, True]).otherwise(
            tests[False, False]
        )

    own = F.replace(low, F.lit(_MARK), F.lit(_UNMARKED))
    plain = F.replace(word, F.lit(_MARK), F.lit(_UNMARKED))
    found = F.exists(F.array(F.replace(own, plain, F.lit(_MARK))), beside)
    n = F.char_length(word)
    overlaps = F.when(n > 1, F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.left(word, i) == F.right(word, i))).otherwise(False)
    inside = F.regexp_replace(_marked(word), F.lit(f"^{_MARK}|{_MARK}$"), F.lit(""))
    anywhere = F.contains(_marked(low), F.concat(F.lit(_MARK), inside, F.lit(_MARK)))
    return F.contains(low, word) & (found | (overlaps & anywhere))


def words_of(low: Column) -> Column:
    """The distinct words of a folded text, each between marks."""
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"{_WORD}+"), F.lit(0)))
    return F.concat(F.lit(_MARK), F.array_join(found, _MARK), F.lit(_MARK))


def has_whole_word(text: Column, indicators: Column, words: Column | None = None) -> Column:
    """Some indicator occurs as a whole word, ignoring case.

    No list, or an empty one, lets everything pass; a list with only blank entries lets nothing pass. Every pattern that is used is a
    constant. Where one text meets many lists, pass it ``folded``, and its ``words_of``: an indicator of one word is looked
    up there, and only others are looked for in the text.
    """
    wanted = F.transform(indicators, lambda w: folded(strip(text_or_empty(w))))
    if words is None:
        # a lambda's argument is evaluated once, not once for each indicator
        low = F.array(folded(text_or_empty(text)))
        found = F.exists(low, lambda t: F.exists(wanted, lambda w: (w != "") & _stands_alone(t, w)))
    else:
        one_word = lambda w: F.rlike(w, F.lit(f"^{_WORD}+$"))
        found = F.exists(
            wanted,
            lambda w: (w != "") & F.when(one_word(w), F.contains(words, F.concat(F.lit(_MARK), w, F.lit(_MARK)))).otherwise(_stands_alone(text_or_empty(text), w)),
        )
    return F.coalesce(F.size(indicators) <= 0, F.lit(True)) | F.coalesce(found, F.lit(False))


def keyword_reason(words: Column) -> Column:
    """``matched: a, b`` with the distinct words in code-point order."""
    return F.concat(F.lit("matched: "), F.array_join(F.array_sort(F.array_distinct(words)), ", "))


def semantic_reason(score: Column) -> Column:
    """``semantic=0.53``; ``format_number`` rounds like the C printf family does."""
    return F.concat(F.lit("semantic="), F.format_number(score, 2))
