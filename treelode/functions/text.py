"""Text expressions with ECMAScript whitespace and line semantics, all inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as white space, and the same set as a regex class.
JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Fixed value: the regex dot of ECMAScript as a class.
DOT = r"[^\n\r\u2028\u2029]"

# A warning line starts with a comment opener and one of these words.
COMMENT_OPENER = r"(?://|#|/\*|\*)"
WARNING_WORDS = ("TODO", "FIXME", "HACK", "NOTE", "WARN", "@deprecated")

# A heading: one to three marks, space, and at least one more character of the same line.
HEADING = rf"^#{{1,3}}{WS}+{DOT}"
LINE_ENDS = ("\r", "\N{LINE SEPARATOR}", "\N{PARAGRAPH SEPARATOR}")
SMALL_FILE_LINES = 50
WINDOW_LINES = 200
PREVIEW_LINES = 8
HEADER_IMPORTS = 10


def js_trim(text: Column) -> Column:
    """Strip every ECMAScript space character; linear, unlike an anchored regex."""
    return F.btrim(text, F.lit(JS_SPACE))


def is_heading(line: Column) -> Column:
    return F.startswith(line, F.lit("#")) & line.rlike(HEADING)


def heading_title(line: Column) -> Column:
    """Text of a heading line, up to whatever else ends a line."""
    title = F.ltrim(F.ltrim(line, F.lit("#")), F.lit(JS_SPACE))
    for end in LINE_ENDS:
        title = F.substring_index(title, end, 1)
    return js_trim(title)


def lines_of(text: Column) -> Column:
    """Split on line feed and keep trailing empty lines, so an empty text is one line."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(lines_of(text))


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, inclusive) joined again."""
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash, or `.` for a file at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def extension_of(path: Column) -> Column:
    """A dot and whatever follows the last dot of the whole path."""
    return F.concat(F.lit("."), F.substring_index(path, ".", -1))


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def head_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern that starts with `^`, empty where it does not match.

    Made optional, the pattern always ends its search at the first character; a failing anchor would be
    tried again at every position of the text.
    """
    flags, _, rest = pattern.partition("^")
    return F.regexp_extract(text, f"{flags}^(?:{rest})?", group)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def line_label(first: Column, last: Column) -> Column:
    return F.concat_ws("-", first.cast("string"), last.cast("string"))


def score_of(distance: Column) -> Column:
    """Two decimals, half rounded towards plus infinity."""
    return F.floor((F.lit(1.0) - distance) * 100 + 0.5) / F.lit(100.0)


def preview_of(content: Column) -> Column:
    """First lines of a chunk, leaving out those that begin with two slashes."""
    shown = F.filter(lines_of(content), lambda line: ~F.startswith(line, F.lit("//")))
    return F.array_join(F.slice(shown, 1, PREVIEW_LINES), "\n")


def chunk_header(path: Column, exports: Column, imports: Column) -> Column:
    """File line, then names and imports when there are any."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("// File: "), path),
        F.when(F.size(exports) > 0, F.concat(F.lit("// Exports: "), F.array_join(exports, ", "))),
        F.when(F.size(imports) > 0,
               F.concat(F.lit("// Imports: "), F.array_join(F.slice(imports, 1, HEADER_IMPORTS), ", "))),
    )


def warning_lines(content: Column) -> Column:
    """`L<n>: <text>` for every line that opens a comment with a warning word."""
    pattern = rf"(?i)^{COMMENT_OPENER}{WS}*(?:{'|'.join(WARNING_WORDS)})"

    def label(line: Column, index: Column) -> Column:
        # Only the left side is trimmed before the test: trimming the right side reads the whole line.
        text = F.ltrim(line, F.lit(JS_SPACE))
        opens = F.startswith(text, F.lit("/")) | F.startswith(text, F.lit("#")) | F.startswith(text, F.lit("*"))
        rest = js_trim(F.regexp_replace(text, rf"^{COMMENT_OPENER}{WS}*", ""))
        return F.when(opens & text.rlike(pattern), F.concat(F.lit("L"), (index + 1).cast("string"), F.lit(": "), rest))

    none = F.array().cast("array<string>")
    # Plain searches of the text rule out most files before they are cut into lines.
    capitals = F.upper(content)
    present = reduce(lambda a, b: a | b, [F.contains(capitals, F.lit(word.upper())) for word in WARNING_WORDS])
    return F.when(
        present,
        F.filter(F.transform(lines_of(content), label), lambda found: found.isNotNull()),
    ).otherwise(none)
