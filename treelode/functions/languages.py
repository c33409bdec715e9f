"""Declarations, names, kinds and imports of the ten parsed extensions, as Column expressions.

Input is a `head` from `treelode.functions.statements`: a top-level statement with its comments
dropped and bracketed bodies emptied, so one anchored pattern per declaration form is enough.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelode.functions import text as X

SCRIPT = (".ts", ".tsx", ".js", ".jsx")
TYPED = (".ts", ".tsx")

_ID = r"[\p{L}\p{N}_$]+"
_WORD = r"[\p{L}\p{N}_]+"

# One (kind of node, pattern with the name as its group) per declaration form.
# Repeated groups are possessive: a match that fails is not tried again in another cut, and nothing recurses.
_DECORATORS = r"(?:@[^\s@]++\s*+)*+"
_SCRIPT_LEAD = rf"^{_DECORATORS}(?:export\s+(?:default\s+)?)?{_DECORATORS}"
_SCRIPT_FORMS = (
    ("function", rf"(?:async\s+)?function\s+({_ID})[\s\S]*\}}$"),
    ("class", rf"class\s+(?!extends\b|implements\b)({_ID})"),
    ("interface", rf"interface\s+({_ID})"),
    ("enum", rf"(?:const\s+)?enum\s+({_ID})"),
    ("alias", rf"type\s+({_ID})\s*[<=]"),
    ("lexical", rf"(?:const|let)\s+(?!enum\b)({_ID})"),
    # A pattern on the left: the name is a bare identifier on the right, else that of a later declarator.
    ("lexical", r"(?:const|let)\s+(?:\{\}|\[\])[^=]*=\s*(?!(?:this|null|true|false|undefined|super)\b)" rf"({_ID})\s*(?:[,;]|$)"),
    ("lexical", rf"(?:const|let)\s+(?:\{{\}}|\[\])[^,]*,\s*({_ID})\s*[=:;]"),
)
_PYTHON_FORMS = (
    ("decorated", rf"^@[\s\S]*?\s(?:async\s+)?(?:def|class)\s+({_WORD})"),
    ("class", rf"^class\s+({_WORD})"),
    ("function", rf"^(?:async\s+)?def\s+({_WORD})"),
)
_GO_FORMS = (
    ("function", rf"^func\s+({_WORD})"),
    ("method", rf"^func\s*\(\)\s*({_WORD})"),
    ("type", rf"^type\s*\(\s*+(?:{_WORD}+\s*+=[^\n;]*+[\n;]\s*+)*+({_WORD}+)(?!\s*=)\b"),
    ("type", rf"^type\s+({_WORD})\b(?!\s*(?:\[\])?\s*=)"),
)
_RUST_LEAD = r"^(?:pub(?:\(\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*+\"[^\"]*+\")?+)\s++)*+"
_RUST_FORMS = (
    ("function", rf"fn\s+(?:r#)?({_WORD})[\s\S]*\}}$"),
    ("struct", rf"struct\s+(?:r#)?({_WORD})"),
    ("enum", rf"enum\s+(?:r#)?({_WORD})"),
    ("trait", rf"trait\s+(?:r#)?({_WORD})"),
    ("type", rf"type\s+(?:r#)?({_WORD})"),
    ("mod", rf"mod\s+(?:r#)?({_WORD})"),
)
_PRIMITIVE = r"(?!(?:[iu](?:8|16|32|64|128|size)|f32|f64|bool|char|str|dyn)\b)"
_RUST_IMPL = (
    rf"^\s*!?\s*{_PRIMITIVE}({_WORD})\s*(?:for\b|where\b|\{{)",
    rf"^(?:default\s+)?(?:unsafe\s+)?impl\b[\s\S]*?\sfor\s+{_PRIMITIVE}({_WORD})\s*(?:where\b|\{{)",
)
_PHP_LEAD = r"(?i)^(?:#\[\]\s*+)*+(?:(?:abstract|final|readonly)\s++)*+"
_PHP_FORMS = (
    ("function", r"function\s+&?\s*([\w\x{80}-\x{10ffff}]+)\s*\("),
    ("class", r"class\s+([\w\x{80}-\x{10ffff}]+)"),
    ("interface", r"interface\s+([\w\x{80}-\x{10ffff}]+)"),
    ("trait", r"trait\s+([\w\x{80}-\x{10ffff}]+)"),
)
_CSS_FORMS = (
    ("rule", r"^([^@\s][\s\S]*?)\s*\{\}$"),
    ("rule", r"^(@media)\b"),
    ("rule", r"^(@import)\b"),
)
_HTML_ELEMENT = r"^<([^\s/>]+)>$"

_SCRIPT_IMPORT = r"^import\b(?!\s*[.(])[^\"'=]*([\"'][\s\S]*?[\"'])"
_PYTHON_FROM = rf"^from\s+((?!__future__\b){_WORD}+(?:\s*+\.\s*+{_WORD}+)*+)\s+import\b"
_PYTHON_RELATIVE = (rf"^from\s*\.[\s\S]*?\bimport\s*\(?(?:\s++|#[^\n]*+\n|\\\n|{_WORD}+(?:\.{_WORD}+)*+\s++as\s++{_WORD}+\s*+,)*+"
                    rf"({_WORD}+)(?!\s++as\b)")
_RUST_USE = rf"^(?:pub(?:\(\))?\s+)?use\s+(?!(?:crate|self|super)\s*;)((?:::\s*)?{_WORD}+(?:\s*+::\s*+{_WORD}+)*+)\s*;$"

_FOUND = "struct<node:string,name:string>"


def _form(head: Column, node: str, pattern: str) -> Column:
    name = X.head_match(head, pattern)
    return F.when(name != "", F.struct(F.lit(node).alias("node"), name.alias("name")).cast(_FOUND))


def _first(head: Column, forms, lead: str = "") -> Column:
    return F.coalesce(*[_form(head, node, lead + pattern) for node, pattern in forms])


def _script(head: Column, extension: Column) -> Column:
    """In plain scripts a type declaration counts only behind `export`, and then as the export itself."""
    keyword = X.head_match(head, rf"^{_DECORATORS}(export|async|function|class|interface|enum|type|const|let)\b")
    exported = keyword == "export"
    typed = extension.isin(*TYPED)
    tries = []
    for node, pattern in _SCRIPT_FORMS:
        found = _form(head, node, _SCRIPT_LEAD + pattern)
        if node in ("interface", "enum", "alias"):
            found = F.when(typed, found).when(exported, _form(head, "export", _SCRIPT_LEAD + pattern))
        tries.append(found)
    return F.when(keyword != "", F.coalesce(*tries))


def _after_generics(text: Column) -> Column:
    """The text after a balanced <...> at its start, however deep, or the text itself where there is none."""
    pieces = F.split(F.replace(text, F.lit("->"), F.lit("  ")), r"(?<=[<>])|(?=[<>])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(held: Column, piece: Column) -> Column:
        depth = held["depth"] + F.when(piece == "<", 1).when(piece == ">", -1).otherwise(0)
        at = held["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((held["end"] == 0) & (depth == 0), at).otherwise(held["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda held: held["end"])
    return F.when(text.startswith("<"), F.substring(text, end + 1, F.length(text))).otherwise(text)


def _rust(head: Column) -> Column:
    rest = _after_generics(F.regexp_replace(head, r"^(?:default\s+)?(?:unsafe\s+)?impl\s*", ""))
    impls = [X.head_match(rest, _RUST_IMPL[0]), X.head_match(head, _RUST_IMPL[1])]
    named = [F.when(n != "", F.struct(F.lit("impl").alias("node"), F.concat(F.lit("impl "), n).alias("name")).cast(_FOUND))
             for n in impls]
    return F.coalesce(F.when(X.head_match(head, r"^(?:default\s+)?(?:unsafe\s+)?(impl)\b") != "", F.coalesce(*named)),
                      _first(head, _RUST_FORMS, _RUST_LEAD))


def _css(head: Column) -> Column:
    frames = X.head_match(head, r"^(@(?:-[a-z]+-)?keyframes)\b") != ""
    name = X.head_match(head, r"^@(?:-[a-z]+-)?keyframes\s+([\w-]+|\"[^\"]*\"|'[^']*')")
    label = F.when(name != "", F.concat(F.lit("@keyframes "), name)).otherwise(F.lit("@keyframes"))
    return F.coalesce(
        _first(head, _CSS_FORMS),
        F.when(frames, F.struct(F.lit("rule").alias("node"), label.alias("name")).cast(_FOUND)))


def declaration(head: Column, extension: Column) -> Column:
    """struct(node, name) of a top-level declaration, or null for anything else."""
    return (
        F.when(extension.isin(*SCRIPT), _script(head, extension))
        .when(extension == ".py", _first(head, _PYTHON_FORMS))
        .when(extension == ".go", _first(head, _GO_FORMS))
        .when(extension == ".rs", _rust(head))
        .when(extension == ".php", _first(head, _PHP_FORMS, _PHP_LEAD))
        .when(extension == ".css", _css(head))
        .when(extension == ".html", _form(head, "element", _HTML_ELEMENT))
    )


def kind_of(name: Column, node: Column, extension: Column) -> Column:
    """The chunk type of a declaration."""
    fourth = F.substring(name, 4, 1)
    script = (
        F.when(name.startswith("use") & (fourth == F.upper(fourth)), F.lit("hook"))
        .when(name.rlike("^[A-Z]"), F.lit("component"))
        .when(node == "class", F.lit("class"))
        .when(node.isin("alias", "interface", "enum"), F.lit("type"))
        .otherwise(F.lit("function"))
    )
    rust = (
        F.when(node.isin("struct", "enum"), F.lit("struct"))
        .when(node.isin("impl", "trait", "type"), node)
        .otherwise(F.lit("function"))
    )
    return (
        F.when(extension.isin(*SCRIPT), script)
        .when(extension == ".py", F.when(node == "class", F.lit("class")).otherwise(F.lit("function")))
        .when(extension == ".go", node)
        .when(extension == ".rs", rust)
        .when(extension == ".php", F.when(node == "class", F.lit("class"))
              .when(node.isin("interface", "trait"), F.lit("type")).otherwise(F.lit("function")))
        .otherwise(node)
    )


def symbols_of(statements: Column, extension: Column) -> Column:
    """Named declarations in source order as structs of name, kind, line_start, line_end."""
    found = F.filter(
        F.transform(statements, lambda s: F.struct(s["row_start"].alias("a"), s["row_end"].alias("b"),
                                                   declaration(s["head"], extension).alias("d"))),
        lambda s: s["d"].isNotNull(),
    )
    return F.transform(found, lambda s: F.struct(
        s["d"]["name"].alias("name"),
        kind_of(s["d"]["name"], s["d"]["node"], extension).alias("kind"),
        (s["a"] + 1).alias("line_start"),
        (s["b"] + 1).alias("line_end"),
    ))


def import_of(head: Column, extension: Column) -> Column:
    """Module named by an import statement, or null. A plain Python `import m` has none."""

    def group(pattern: str) -> Column:
        found = X.head_match(head, pattern)
        return F.when(found != "", found)

    return (
        F.when(extension.isin(*SCRIPT), F.regexp_replace(group(_SCRIPT_IMPORT), "['\"]", ""))
        .when(extension == ".py", F.coalesce(group(_PYTHON_FROM), group(_PYTHON_RELATIVE)))
        .when(extension == ".rs", group(_RUST_USE))
    )


def imports_of(statements: Column, extension: Column) -> Column:
    """Imported modules in source order, repeats kept."""
    importing = extension.isin(*SCRIPT, ".py", ".rs")
    return F.when(importing, F.filter(F.transform(statements, lambda s: import_of(s["head"], extension)),
                                      lambda m: m.isNotNull())).otherwise(F.array().cast("array<string>"))


def exports_of(symbols: Column) -> Column:
    """All distinct symbol names in first-seen order, whether exported or not."""
    return F.array_distinct(F.transform(symbols, lambda s: s["name"]))
