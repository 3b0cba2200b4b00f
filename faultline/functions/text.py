"""Text, token and path expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Blanks as Unicode text knows them, the word-or-symbol token pattern, the C
# delimiters, the word break of code slices, and a word of two or more characters.
BLANK = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
WORD_OR_SYMBOL = r"[a-zA-Z\p{Nd}'\"#!$\x{80}-\x{2318}`]+|[^\s\x0B\x1c-\x1f\x85\p{Z}]"
C_DELIMITERS = r"[\s\x0B\x1c-\x1f\x85\p{Z}+\-*/,;><=()\[\]{}]"
WORD_BREAK = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+|\\t+|\\n+"
SLICE_BREAK = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+|\\t+|\\n+|->|_"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
SPACED_MARKS = r"([.@\-~%^&*()+={}|\\\[\]:;,<>?/])"
FUNCTION_DEFINITION = (
    r"\s*(?:(?:inline|static)\s+){0,2}\w+\s+\*?\s*\w+\s*\([^!@#$+%^;]+?\)\s*\{"
)
CODE_FILE = r"^.*\.(c|c\+\+|cpp|h|hpp|cc)$"

NULL_TOKEN = "<NULL>"

# C and C++ words whose use is counted.
CODE_KEYWORDS = (
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern",
    "float", "for", "goto", "if", "int", "long", "register", "return", "short", "signed", "sizeof", "static",
    "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while", "asm", "dynamic_cast",
    "namespace", "reinterpret_cast", "try", "bool", "explicit", "new", "static_cast", "typeid", "catch", "false",
    "operator", "template", "typename", "class", "friend", "private", "this", "using", "const_cast", "inline",
    "public", "throw", "virtual", "delete", "mutable", "protected", "true", "wchar_t", "malloc", "calloc", "realloc",
    "free", "alloca", "allocinteger",
)


def squeeze(text: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def split_sentence(text: Column) -> Column:
    """Blanks around punctuation marks, underscores as blanks, runs of blanks squeezed."""
    return squeeze(F.regexp_replace(F.translate(text, "_", " "), SPACED_MARKS, " $1 "))


def word_or_symbol_tokens(text: Column, lower: bool = True) -> Column:
    """Runs of word-like characters or single symbols; lone underscores are dropped."""
    tokens = F.regexp_extract_all(text, F.lit(WORD_OR_SYMBOL), F.lit(0))
    tokens = F.filter(tokens, lambda t: t != "_")
    return F.transform(tokens, F.lower) if lower else tokens


def delimiter_tokens(text: Column) -> Column:
    """Split at blanks and C delimiters; empty pieces are dropped."""
    return F.filter(F.split(text, C_DELIMITERS), lambda t: t != "")


def blank_tokens(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda t: t != "")


def long_words(text: Column) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(LONG_WORD), F.lit(0))


def slice_word_count(text: Column, pattern: str = SLICE_BREAK) -> Column:
    """Pieces of a code slice, empty ones counted; a missing side has none. ``WORD_BREAK`` as the pattern counts as the
    filter of training rows does."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, pattern)))


def function_definitions(code: Column) -> Column:
    return F.regexp_count(code, F.lit(FUNCTION_DEFINITION))


def pad(tokens: Column, length: int, filler: Column | None = None) -> Column:
    """Exactly ``length`` entries: cut, or filled up with ``<NULL>``."""
    fill = F.array_repeat(filler if filler is not None else F.lit(NULL_TOKEN), length)
    return F.slice(F.concat(tokens, fill), 1, length)


def pad_lines(lines: Column, max_lines: int, length: int) -> Column:
    """Array of token lists to exactly ``max_lines`` x ``length``."""
    empty = F.array_repeat(F.lit(NULL_TOKEN), length)
    return pad(F.transform(lines, lambda x: pad(x, length)), max_lines, empty)


def pad_files(files: Column, max_files: int, max_lines: int, length: int) -> Column:
    """Files x lines x tokens to a fixed shape."""
    empty = F.array_repeat(F.array_repeat(F.lit(NULL_TOKEN), length), max_lines)
    return pad(F.transform(files, lambda x: pad_lines(x, max_lines, length)), max_files, empty)


def drop_blank(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.length(squeeze(x)) > 0)


def format_change(added: Column, removed: Column) -> Column:
    """``added_code:  a b removed_code:  c`` for one file."""
    side = lambda x: F.when(F.size(x) > 0, F.concat(F.lit(" "), F.array_join(x, " "))).otherwise("")
    return F.concat(F.lit("added_code: "), side(added), F.lit(" removed_code: "), side(removed))


def token_windows(tokens: Column, window: int, overlap: int) -> Column:
    """Windows of ``window`` tokens, each starting ``window - overlap`` after the one before; the
    last one holds what is left. An empty list gives one empty window."""
    step = window - overlap
    n = F.size(tokens)
    count = F.greatest(F.ceil((n - window) / F.lit(step)), F.lit(0)) + 1
    starts = F.sequence(F.lit(0), (count - 1).cast("int"))
    return F.transform(starts, lambda i: F.slice(tokens, i * step + 1, window))


def subsystem(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "root").otherwise(parts[0])


def directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "root").otherwise(
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_code_file(path: Column, pattern: str = CODE_FILE, skip_tests: bool = True) -> Column:
    ok = path.rlike(pattern)
    return ok & ~F.contains(F.lower(path), F.lit("test")) if skip_tests else ok


def extract_ids(text: Column, rules: Sequence[dict]) -> Column:
    """Ids found by every rule whose ``contains`` pattern matches.

    A rule has ``contains`` and ``mode``: ``none`` (the text itself), ``regex`` (every match of
    ``pattern``) or ``cut`` (the text without the first match of ``pattern``).
    """
    found = []
    for rule in rules:
        mode = rule["mode"]
        if mode == "none":
            ids = F.array(text)
        elif mode == "regex":
            ids = F.regexp_extract_all(text, F.lit(rule["pattern"]), F.lit(0))
        elif mode == "cut":
            hit = F.regexp_extract(text, rule["pattern"], 0)
            ids = F.when(hit != "", F.array(F.replace(text, hit, F.lit(""))))
        else:
            raise ValueError(f"unknown extraction mode: {mode}")
        found.append(F.when(text.rlike(rule["contains"]), F.coalesce(ids, F.array().cast("array<string>"))))
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(f, empty) for f in found]))
