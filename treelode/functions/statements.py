"""Cut source text into its top-level statements.

This is the one piece of parsing that SQL expressions cannot state: finding where brackets, strings
and comments end. Everything after it (which statements are declarations, their names and kinds,
imports, line ranges) is Column code in `treelode.functions.languages`, which works on the `head` of
a statement: its text with comments dropped and bracketed bodies emptied.
"""
from __future__ import annotations

import logging
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from treelode import schema

log = logging.getLogger(__name__)

# Lexical rules. `skip` is comments, `text` is string literals, `open` the brackets
# whose bodies are emptied, `starts` every character a comment or literal can begin with, and `end`
# how a statement ends: at a newline (asi, go) or only at a closing brace or semicolon (brace).
_DQ, _SQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_DQ_ML, _SQ_ML = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\Z)', r"'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\Z)"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_LEX = {
    "script": dict(skip=rf"//[^\n]*|{_BLOCK}|\A\#![^\n]*", text=rf"{_DQ}|{_SQ}", open="([{", starts="\"'/`#", end="asi"),
    "go": dict(skip=rf"//[^\n]*|{_BLOCK}", text=rf"{_DQ}|{_SQ}|`[^`]*(?:`|\Z)", open="([{", starts="\"'/`", end="go"),
    "rust": dict(skip=rf"//[^\n]*|{_BLOCK}", open="([{", starts="\"'/", end="brace",
                 text=rf"(?<=r)\"[^\"]*\"|(?<=r#)\".*?\"\#|(?<=r##)\".*?\"\#\#"
                      rf"|(?<=r###)\".*?\"\#\#\#|{_DQ_ML}"
                      r"|'(?:[^'\\\n]|\\[^\n]{1,10}?)'|'\w+"),
    "php": dict(skip=rf"(?://|\#(?!\[))[^\n]*?(?=\?>|\n|\Z)|{_BLOCK}|\?>.*?(?:<\?php|<\?=|\Z)", open="([{",
                starts="\"'/#?<", end="brace",
                text=rf"<<<[ \t]*[\"']?(?P<doc>\w+)[\"']?\n.*?\n[ \t]*(?P=doc)\b|{_DQ_ML}|{_SQ_ML}"),
    "css": dict(skip=_BLOCK, text=rf"{_DQ}|{_SQ}", open="{", starts="\"'/", end="brace"),
    "python": dict(skip=r"\#[^\n]*|\\\n", open="([{", starts="\"'#\\", end="indent",
                   text=rf'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+(?:"""|\Z)'
                        rf"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+(?:'''|\Z)|{_DQ}|{_SQ}"),
}
LANGUAGE_OF = {
    ".ts": "script", ".tsx": "script", ".js": "script", ".jsx": "script", ".py": "python", ".go": "go",
    ".rs": "rust", ".php": "php", ".html": "html", ".css": "css",
}
_BLANK = " \t\r\f\v\ufeff"
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def _compile(rule: dict) -> dict:
    """Patterns that first pass over everything no rule can start with, then match one token."""
    lit, opens = f"(?P<skip>{rule['skip']})|(?P<text>{rule['text']})", re.escape(rule["open"])
    closes, starts = re.escape("".join(_CLOSER[c] for c in rule["open"])), re.escape(rule["starts"])
    deep = rf"[^{starts}{opens}{closes}]*+(?:{lit}|(?P<open>[{opens}])|(?P<close>[{closes}])|(?P<other>.)|\Z)"
    brace = rf"[^{starts}{{}}]*+(?:{lit}|(?P<open>\{{)|(?P<close>\}})|(?P<other>.)|\Z)"
    return dict(
        rule,
        flat=re.compile(rf"{lit}|(?P<nl>\n\s*)|(?P<open>[{opens}])|(?P<close>[{closes}])|(?P<semi>;)"
                        rf"|(?P<run>[^\n;{starts}{opens}{closes}]+)|(?P<other>.)", re.S),
        deep=re.compile(deep, re.S),
        brace=re.compile(brace, re.S),
        block=re.compile(rf"{rule['skip']}|(?P<keep>{rule['text']})", re.S),
    )


_RULES = {name: _compile(rule) for name, rule in _LEX.items()}
_PYTHON_BODY = re.compile(
    rf"[^\"'#\\(\[{{\n]*+(?:{_LEX['python']['skip']}|(?P<text>{_LEX['python']['text']})|(?P<open>[(\[{{])"
    r"|(?P<next>\n(?=[^\s#]))|.|\Z)", re.S)
_FIRST = re.compile(r"\s*([\w$]+|=>|\+\+|--|!=|.)", re.S)
_LAST = re.compile(r"(?:[\w$]+|=>|\+\+|--|!=|[^\w\s])\Z")
_REGEX_LITERAL = re.compile(r"/(?![*/>])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_NESTED_COMMENT = re.compile(r"/\*|\*/")
_BEFORE_REGEX = re.compile(r"(?:^|[=(\[{,;:!&|?+*%~^>-]|\b(?:return|typeof|case|in|of|do|else|void|delete))\s*\Z")

# Statements of a script that end at their closing brace, tokens that carry a statement
# on over a line break, and the words that do so.
_SCRIPT_BLOCK = re.compile(
    r"(?:@\S+\s+)*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?"
    r"(?:const\s+enum|function|class|interface|enum|namespace|module|global|if|for|while|do|try|switch|with)\b|\{|\w+\s*:")
_MORE_AFTER = re.compile(r"(?:=>|!=|[=+\-*/%&|^~?:<,.])\Z")
_MORE_BEFORE = re.compile(r"(?!\+\+|--)(?:!=|[.?:=+\-*/%&|^<>,)\]}(\[`])")
_WORDS_AFTER = {"extends", "implements", "new", "typeof", "in", "of", "instanceof", "as", "satisfies", "keyof",
                "import", "export", "default", "from", "async", "await", "const", "let", "var", "type", "function",
                "class", "interface", "enum", "abstract", "declare", "namespace", "module"}
_WORDS_BEFORE = {"instanceof", "in", "of", "as", "satisfies", "extends", "implements", "is", "else", "catch",
                 "finally", "from"}
_DECORATORS = re.compile(r"(?:@[\w$.]+(?:\(\))?\s*)+")
_BLOCK_MORE = {"{", "|", "&", "[", "extends", "implements", "else", "catch", "finally", "is"}
_GO_ENDS = re.compile(r"[\w)\]}\"'`]\Z|\+\+\Z|--\Z")
_RUST_SEMICOLON = re.compile(r"(?:pub(?:\(\))?\s+)?(?:use|let|static|type|const(?!\s+(?:unsafe\s+|async\s+|extern\s+)*fn))\b")
_PHP_BLOCK = re.compile(r"(?i)(?:#\[\]\s*)*(?:(?:function\s+&?\s*\w+|abstract|final|readonly|class|interface|trait|enum|"
                        r"namespace|if|else|elseif|for|foreach|while|switch|try|catch|finally|do|declare)\b|\{)")


def _close(text: str, pos: int, rule: dict, first: str) -> int:
    """Offset just after the bracket or template that opened before `pos` as `first`."""
    stack, size, script = [first], len(text), rule["end"] == "asi"
    deep, brace = rule["deep"].match, rule["brace"].match
    while stack and pos < size:
        if stack[-1] == "`":
            hit = _TEMPLATE.search(text, pos)
            if hit is None:
                return size
            pos = hit.end()
            if hit.group() == "`":
                stack.pop()
            elif hit.group() == "${":
                stack.append("{")
            continue
        # Inside braces only braces count, so a lone bracket in markup text cannot hide the end.
        hit = brace(text, pos) if stack[-1] == "{" else deep(text, pos)
        pos, kind = hit.end(), hit.lastgroup
        if kind == "open":
            stack.append(text[pos - 1])
        elif kind == "close":
            if _CLOSER[stack[-1]] == text[pos - 1]:
                stack.pop()
        elif kind == "other" and script:
            if text[pos - 1] == "`":
                stack.append("`")
            elif text[pos - 1] == "/":
                pos = _slash(text, pos - 1)
        elif kind == "skip":
            pos = _comment(text, hit.start("skip"), pos, rule)
    return pos


def _slash(text: str, at: int) -> int:
    """Offset after a regular expression literal, or after the slash when it divides."""
    literal = _REGEX_LITERAL.match(text, at) if _BEFORE_REGEX.search(text[max(0, at - 40):at]) else None
    return literal.end() if literal else at + 1


def _comment(text: str, at: int, end: int, rule: dict) -> int:
    """Block comments nest in Rust only."""
    if rule is not _RULES["rust"] or not text.startswith("/*", at):
        return end
    depth, pos = 1, at + 2
    while depth:
        hit = _NESTED_COMMENT.search(text, pos)
        if hit is None:
            return len(text)
        depth, pos = depth + (1 if hit.group() == "/*" else -1), hit.end()
    return pos


class _Cutter:
    """Collects the statement being read and the finished ones."""

    def __init__(self, text: str):
        self.text, self.done, self.head = text, [], []
        self.begin = self.end = self._at = self._row = 0

    def row(self, offset: int) -> int:
        self._row += self.text.count("\n", self._at, offset) if offset >= self._at else -self.text.count("\n", offset, self._at)
        self._at = offset
        return self._row

    def add(self, piece: str, at: int, end: int) -> None:
        if not self.head:
            self.begin = at
        self.head.append(piece)
        self.end = end

    def gap(self) -> None:
        if self.head and self.head[-1] != " ":
            self.head.append(" ")

    def flush(self, head: str | None = None, end: int | None = None) -> None:
        if self.head:
            if head is None:
                head = "".join(self.head).strip()
            first = self.row(self.begin)
            self.done.append((head, first, self.row(self.end if end is None else end)))
        self.head = []


def _ends_at_newline(kind: str, out: _Cutter, operand: bool, token: str) -> bool:
    """Whether a line break ends the statement; `operand` says it was read up to a literal or bracket."""
    if kind == "brace":
        return False
    if not operand:
        last = _LAST.search(out.text[max(out.begin, out.end - 40):out.end])
        last = last.group() if last else ""
        if kind == "go":
            return bool(_GO_ENDS.search(last))
        if last in _WORDS_AFTER or (_MORE_AFTER.search(last) and last not in ("++", "--")):
            return False
    elif kind == "go":
        return True
    if token == "{":
        return not _SCRIPT_BLOCK.match("".join(out.head))
    if out.head[0][0] == "@" and _DECORATORS.fullmatch("".join(out.head)):
        return False
    return not (token in _WORDS_BEFORE or _MORE_BEFORE.match(token))


def _cut_braced(text: str, language: str) -> list[tuple[str, int, int]]:
    rule = _RULES[language]
    kind, flat, out = rule["end"], rule["flat"].match, _Cutter(text)
    script = kind == "asi"
    pos, size, operand, newline, closed = 0, len(text), False, False, False
    if language == "php":
        opening = re.search(r"<\?(?:php\b|=)", text)
        pos = opening.end() if opening else size
    while pos < size:
        hit = flat(text, pos)
        at, pos, group = pos, hit.end(), hit.lastgroup
        if group == "skip":
            pos = _comment(text, at, pos, rule)
        if group in ("nl", "skip") or (group == "run" and not hit.group().strip(_BLANK)):
            newline = newline or group == "nl" or "\n" in text[at:pos]
            out.gap()
            continue
        if out.head and (closed or newline):
            token = _FIRST.match(text, at).group(1)
            if closed:
                if not (token in _BLOCK_MORE or (token == "while" and out.head[0].startswith("do"))):
                    out.flush()
            elif _ends_at_newline(kind, out, operand, token):
                out.flush()
        newline = closed = False
        operand = group not in ("run", "semi", "other")
        first = text[at]
        if group == "semi":
            out.add(";", at, pos)
            _finish(out, language)
        elif group == "open" or (first == "`" and script):
            pos = _close(text, pos, rule, first)
            operand = True
            out.add(first + _CLOSER.get(first, "`"), at, pos)
            if first == "{":
                head = "".join(out.head)
                if script:
                    closed = bool(_SCRIPT_BLOCK.match(head))
                elif language == "css" or (language == "php" and _PHP_BLOCK.match(head)) or (
                        language == "rust" and not _RUST_SEMICOLON.match(head)):
                    _finish(out, language)
            elif first == "[" and language == "rust" and "".join(out.head) in ("#[]", "#![]"):
                out.flush()
        elif first == "/" and script:
            pos = _slash(text, at)
            operand = pos > at + 1
            out.add(text[at:pos], at, pos)
        elif group == "run":
            run = hit.group()
            bare = run.strip(_BLANK)
            lead = run.index(bare)
            if lead:
                out.gap()
            out.add(bare, at + lead, at + lead + len(bare))
            if lead + len(bare) < len(run):
                out.gap()
        elif group != "close":
            out.add(text[at:pos], at, pos)
    _finish(out, language)
    return out.done


def _finish(out: _Cutter, language: str) -> None:
    """Close a statement; keep its own spelling where a name sits inside a bracket."""
    head = "".join(out.head).strip()
    if language == "css":
        brace = head[-2:] == "{}"
        raw = out.text[out.begin:out.end]
        head = _before_brace(raw) + "{}" if brace else raw
    out.flush(head)


def _before_brace(raw: str) -> str:
    pos = 0
    while (hit := _RULES["css"]["brace"].match(raw, pos)).lastgroup != "open":
        pos = hit.end()
    return raw[:hit.end() - 1].rstrip()


def _cut_go(text: str) -> list[tuple[str, int, int]]:
    lines = None
    out = []
    for head, first, last in _cut_braced(text, "go"):
        if head.startswith("type") and re.fullmatch(r"type\s*\(\)", head):
            lines = lines or text.split("\n")
            grouped = "\n".join(lines[first:last + 1])
            head = _RULES["go"]["block"].sub(lambda m: m.group("keep") or " ", grouped).strip()
        out.append((head, first, last))
    return out


def _cut_python(text: str) -> list[tuple[str, int, int]]:
    """A statement starts at column 0 and runs to the next one; decorators join what they decorate."""
    rule, out = _RULES["python"], _Cutter(text)
    flat, pos, size = rule["flat"].match, 0, len(text)
    while pos < size:
        hit = flat(text, pos)
        at, pos, group = pos, hit.end(), hit.lastgroup
        if group == "skip":
            out.gap()
        elif group == "nl":
            head = "".join(out.head).strip()
            if not head or (head[0] == "@" and not re.search(r"\s(?:async\s+)?(?:def|class)\b", head)):
                out.gap()
                continue
            # The first line is complete: pass over the indented body.
            stop, inner = at, at
            while stop < size:
                found = _PYTHON_BODY.match(text, stop)
                if found.lastgroup == "next":
                    stop = found.end() - 1
                    break
                stop = found.end()
                if found.lastgroup == "open":
                    stop = _close(text, stop, rule, text[stop - 1])
                if found.lastgroup in ("open", "text"):
                    inner = stop
            end = _body_end(text, at, stop, max(out.end, inner if inner > at else 0))
            out.flush(text[out.begin:out.end] if head.startswith("from") else head, end)
            pos = stop
        elif group == "open":
            pos = _close(text, pos, rule, text[at])
            out.add(text[at] + _CLOSER[text[at]], at, pos)
        elif group == "semi" and not re.match(r"@|(?:async\s+)?def\b|class\b", "".join(out.head)):
            out.flush()
        elif group == "run" and not hit.group().strip(_BLANK):
            out.gap()
        else:
            run = text[at:pos].lstrip("\ufeff")
            out.add(run, pos - len(run), at + len(text[at:pos].rstrip()))
    head = "".join(out.head).strip()
    out.flush(text[out.begin:out.end] if head.startswith("from") else head)
    return out.done


_FIRST_INDENT = re.compile(r"(?:[^\S\n]*(?:#[^\n]*)?\n)*([^\S\n]*)")


def _body_end(text: str, header_end: int, stop: int, least: int) -> int:
    """End of the last code line, moved over comment lines that are indented like the body."""
    comments, end = [], stop
    while end > least:  # back over blank and comment lines
        begin = max(text.rfind("\n", 0, end) + 1, least)
        line = text[begin:end]
        bare = line.strip()
        if bare and bare[0] != "#":
            end = begin + len(line.rstrip())
            break
        if bare and begin > least:
            comments.append((len(line) - len(line.lstrip()), begin + len(line.rstrip())))
        end = begin - 1
    end = max(end, least)
    if comments and end > header_end:
        indent = len(_FIRST_INDENT.match(text, header_end + 1).group(1))
        for width, offset in reversed(comments):
            if width < indent:
                break
            end = offset
    return end


# Elements without content, and the start tags before which an open element ends.
_VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem "
            "meta nextid param source track wbr".split())
_ENDS_BEFORE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "optgroup": {"optgroup"}, "rb": {"rb", "rt", "rp"}, "rt": {"rb", "rt", "rp"}, "rp": {"rb", "rt", "rp"},
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr main nav ol p pre section".split()),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>"
                  r"|<(?P<start>[A-Za-z][^\s/>]*)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>", re.S)


def _cut_html(text: str) -> list[tuple[str, int, int]]:
    """Root elements; an element left open ends where its parent or the text does."""
    out, stack, pos = _Cutter(text), [], 0

    def pop(end: int) -> None:
        stack.pop()
        if not stack:
            out.flush(end=end)

    while (hit := _TAG.search(text, pos)) is not None:
        pos = hit.end()
        if hit["end"]:
            name = hit["end"].lower()
            if name in stack:
                while stack[-1] != name:
                    pop(hit.start())
                pop(pos)
        elif hit["start"]:
            name, single = hit["start"].lower(), hit["rest"].rstrip().endswith("/")
            while stack and (name in _ENDS_BEFORE.get(stack[-1], ()) or (stack[-1] == "colgroup" and name != "col")):
                pop(hit.start())
            if name in ("script", "style") and not single:
                closing = re.compile(rf"</{name}[^>]*>", re.I).search(text, pos)
                pos = closing.end() if closing else len(text)
                continue
            if not stack:
                out.add(f"<{hit['start']}{'/' if single else ''}>", hit.start(), pos)
            stack.append(name)
            if single or name in _VOID:
                pop(pos)
    while stack:
        pop(len(text))
    return out.done


def cut(text: str, extension: str) -> list[tuple[str, int, int]] | None:
    """Top-level statements as (head, first row, last row), rows counted from 0."""
    language = LANGUAGE_OF.get(extension)
    if language is None:
        return None
    if language == "html":
        return _cut_html(text)
    if language == "python":
        return _cut_python(text)
    return _cut_go(text) if language == "go" else _cut_braced(text, language)


@F.arrow_udf(schema.STATEMENTS)
def _statements(content: pa.Array, extension: pa.Array) -> pa.Array:
    heads, firsts, lasts, offsets, missing = [], [], [], [0], []
    for at in range(len(content)):  # one text as an object at a time
        text, ext = content[at].as_py(), extension[at].as_py()
        try:
            found = None if text is None else cut(text, ext)
        except Exception:  # a text that cannot be cut is chunked by lines instead
            log.warning("a %s text of %d characters could not be cut", ext, len(text), exc_info=True)
            found = None
        for head, first, last in found or ():
            heads.append(head)
            firsts.append(first)
            lasts.append(last)
        offsets.append(len(heads))
        missing.append(found is None)
    fields = [pa.field("head", pa.string(), False), pa.field("row_start", pa.int32(), False), pa.field("row_end", pa.int32(), False)]
    columns = [pa.array(heads, pa.string()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields),
                                    mask=pa.array(missing))


def statements_of(content: Column, extension: Column) -> Column:
    """Statements of a file, or null when its extension has no rules or the text cannot be cut."""
    known = extension.isin(*LANGUAGE_OF)
    return _statements(F.when(known, content), extension)
