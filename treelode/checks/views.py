"""Files, chunks and states that Spark derives row by row from the provided tables.

One table row becomes one file, so no view groups rows and none depends on how keys are spread.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions import text as X
from treelode.functions.batches import slices
from treelode.session import spread
from treelode.sources import project as P
from treelode.sources.tree import category_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_files(spark: SparkSession, folder: str, prepare: Callable[[DataFrame], DataFrame] = lambda scan: scan) -> DataFrame:
    path = F.expr("concat('docs/', source, '/', lang, '/', doc_id, '.md')")
    return prepare(table(spark, folder, "documents")).select("lang", "source", path.alias("relative_path"), F.col("text").alias("content"))


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.expr("concat('src/pages/', page_id, '.html')")
    return spread(table(spark, folder, "pages")).select(path.alias("relative_path"), F.col("html").alias("content"))


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages as one project: relative_path, extension, category."""
    paths = doc_files(spark, folder).select("relative_path").unionAll(page_files(spark, folder).select("relative_path"))
    typed = paths.withColumn("extension", X.extension_of(F.col("relative_path")))
    return typed.withColumn("category", category_of(F.col("extension")))


# Path shapes that exercise include, exclude, ignore and extension rules; %s is the document number.
PATH_SHAPES = (
    "src/a/f%s.ts", "src/f%s.test.ts", "src/f%s.TS", "lib/f%s.ts", "src/node_modules/m/f%s.js", "docs/f%s.mdx",
    "src/.cache/f%s.py", "src/gen/f%s.go", "src/gen/keep/f%s.go", "src/secrets.f%s.json", "SRC/x/f%s.css",
    "packages/p/f%s.min.js", "src/dist/f%s.ts", "src/_f%s.tsx", "apps/f%s.sql", "apps/keep%s.sql", "src/a.b/f%s",
    "f%s.md", "docs/.f%s.md", "src/f%s.pem",
)
IGNORE_LINES = ("# generated", "gen/", "!gen/keep/", "*.sql", "!keep*.sql", "!secrets.*")


def shaped_paths(spark: SparkSession, folder: str) -> DataFrame:
    shapes = F.array(*[F.lit(s) for s in PATH_SHAPES])
    shape = F.get(shapes, (F.col("doc_id") % len(PATH_SHAPES)).cast("int"))
    path = F.replace(shape, F.lit("%s"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents").select(path.alias("relative_path"))


def long_files(spark: SparkSession, folder: str, prepare: Callable[[DataFrame], DataFrame] = spread) -> DataFrame:
    """Each document repeated one to eight times, so that files pass 50 and 200 lines."""
    text = F.expr("array_join(array_repeat(text, cast(doc_id % 8 + 1 as int)), '\n')")
    named = table(spark, folder, "documents").withColumn("file_path", F.expr("concat('db/', source, '/', doc_id, '.sql')"))
    return prepare(named).select(
        "file_path", F.lit(".sql").alias("extension"),
        F.lit("code").alias("category"), text.alias("content"))


def heading_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which some lines became headings, near-headings and blank lines."""
    content = F.array_join(F.transform(X.lines_of(F.col("text")), lambda line, i: (
        F.when(i % 13 == 4, F.concat(F.lit("### \t "), line, F.lit("  ")))
        .when((i + F.col("doc_id")) % 5 == 0, F.concat(F.lit("# "), line))
        .when(i % 7 == 3, F.concat(F.lit("#### "), line))
        .when(i % 11 == 6, F.concat(F.lit("##"), line))
        .when(i % 9 == 8, F.lit("   "))
        .otherwise(line))), "\n")
    return spread(table(spark, folder, "documents")).select(
        F.expr("concat('docs/', source, '/', doc_id, '.md')").alias("file_path"), F.lit(".md").alias("extension"),
        F.lit("docs").alias("category"), content.alias("content"))


MARKERS = ("// TODO ", "  # note: ", "/* FIXME ", "* @Deprecated ", "/** TODO ", "x // TODO ", "")


def marked_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose lines open with comment markers in turn."""
    markers = F.array(*[F.lit(m) for m in MARKERS])
    content = F.array_join(F.transform(X.lines_of(F.col("text")), lambda line, i: (
        F.concat(F.get(markers, (i % len(MARKERS)).cast("int")), line))), "\n")
    return spread(table(spark, folder, "documents")).select(
        F.expr("concat('src/', doc_id, '.py')").alias("file_path"), F.lit(".py").alias("extension"),
        content.alias("content"))


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as stored chunks."""
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id", "concat('c', vec_id) as id",
        "concat('src/m', vec_id % 20, '/f', vec_id, element_at(array('.ts', '.tsx', '.py', '.go', '.md'), cast(vec_id % 5 as int) + 1)) as file_path",
        "case when label < 2 then 'doc_section' when label < 5 then 'function' when label < 8 then 'class' else 'hook' end as chunk_type",
        "concat('s', label) as name", "cast(vec_id % 40 + 1 as int) as line_start", "cast(vec_id % 40 + 1 + vec_id % 7 as int) as line_end",
        "embedding as vector")


def with_text(chunks: DataFrame) -> DataFrame:
    """Add the content of stored chunks. Searches do so for the rows they found, not for all."""
    return chunks.withColumn("content", F.expr(
        "concat('// File: f', vec_id, '\n\n', array_join(transform(sequence(1, cast(3 + vec_id % 12 as int)), "
        "i -> if(i % 4 = 0, concat('// note ', i), concat('row ', i))), '\n'))"))


def query_vectors(spark: SparkSession, folder: str, *ids: int) -> list[tuple[int, list[float]]]:
    """Vectors of a few rows, as a caller would hold them after embedding its queries."""
    rows = chunk_vectors(spark, folder).where(F.col("vec_id").isin(*ids)).select("vec_id", "vector").collect()
    return sorted((r["vec_id"], list(r["vector"])) for r in rows)


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (relative_path, content) below a root, or remove them where content is null; tasks do it. How many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = P.open_root(root)
        for batch in slices(batches, "content"):
            for path, text in zip(batch.column("relative_path").to_pylist(), batch.column("content").to_pylist()):
                if text is None:
                    filesystem.delete_file(f"{base}/{path}")
                    continue
                filesystem.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with filesystem.open_output_stream(f"{base}/{path}") as stream:
                    stream.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return files.select("relative_path", "content").mapInArrow(rows, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def old_state(spark: SparkSession, folder: str) -> DataFrame:
    """What was indexed: before German documents were added, and with two sources in another wording."""
    files = doc_files(spark, folder).where("lang <> 'de'")
    return files.withColumn("content", F.expr("if(source in ('src2', 'src9'), concat(content, '\nold'), content)"))


def new_state(spark: SparkSession, folder: str) -> DataFrame:
    """What is there now: one source was removed."""
    return doc_files(spark, folder).where("source <> 'src5'")


def hashed(files: DataFrame) -> DataFrame:
    return files.select("relative_path", X.content_hash(F.col("content")).alias("hash"))


@dataclass(frozen=True)
class Sample:
    """A source file per part. @K is the part key, @N the number of filler lines.

    Expected symbols are (name, kind, first line, last line) in SQL over k and n.
    """

    path: str
    text: str
    filler: str
    symbols: tuple[tuple[str, str, str, str], ...]
    imports: tuple[str, ...] = ()


SAMPLES = {
    "typescript": Sample("src/ts/p@K.ts", '''import { a, type B } from "lib/b@K";
import type X from './x'
import 'side-effect'

/** Not a brace: { */
export function usePart@K(x: { a: string }): { b: number } {
  const s = `${x.a ? `}` : "{"} }`; // }
  return /[}/]/.test(s) ? { b: 1 } : { b: @N }
}

@Table({ name: 'p@K' })
export class Box@K extends Base<X> {
@FILL
}
export const render@K = (n: number) => {
  return <p>Don't {n} :) </p>
}
interface shape@K { q: string }
type kind@K =
  | 'a'
  | 'b'
enum Tone@K { Low, High }
const one = 1, two = 2
let { q } = source@K
class plain@K {}
export default async function main@K() {}
function signature(a: string): void
export { one, two }
// TODO sort by @K
''', "  step@I() { return { v: '}' } }", (
        ("'usePart' || k", "hook", "6", "9"), ("'Box' || k", "component", "11", "14 + n - 1"),
        ("'render' || k", "function", "15 + n - 1", "17 + n - 1"), ("'shape' || k", "type", "18 + n - 1", "18 + n - 1"),
        ("'kind' || k", "type", "19 + n - 1", "21 + n - 1"), ("'Tone' || k", "component", "22 + n - 1", "22 + n - 1"),
        ("'one'", "function", "23 + n - 1", "23 + n - 1"), ("'source' || k", "function", "24 + n - 1", "24 + n - 1"),
        ("'plain' || k", "class", "25 + n - 1", "25 + n - 1"), ("'main' || k", "function", "26 + n - 1", "26 + n - 1"),
    ), ("'lib/b' || k", "'./x'", "'side-effect'")),
    "javascript": Sample("src/js/p@K.jsx", '''import React from 'react'
const use_part@K = () => {
@FILL
}
var skipped = 1
function* generator() {}
export class Card@K {}
class small@K {}
interface ignored {}
export enum mode@K { A }
export * from './all'
''', "  call(@I, '}')", (
        ("'use_part' || k", "hook", "2", "3 + n"), ("'Card' || k", "component", "6 + n", "6 + n"),
        ("'small' || k", "class", "7 + n", "7 + n"), ("'mode' || k", "function", "9 + n", "9 + n"),
    ), ("'react'",)),
    "python": Sample("src/py/p@K.py", '''"""Module text
def not_code(): pass
"""
import os
from lib.b@K import (one,
                     two)
from . import three

@register("p@K",
          kind=")")
async def load@K(a, b="}"):
@FILL
    # end of load

class Part@K(Base):
    def method(self):
        return """
def inside(): pass
"""

@frozen
class Decorated@K: pass
LIMIT = [
    1]
if LIMIT:
    def hidden(): pass
def last@K(): return @N
''', "    step(@I)  # note", (
        ("'load' || k", "function", "9", "12 + n"), ("'Part' || k", "class", "14 + n", "18 + n"),
        ("'Decorated' || k", "function", "20 + n", "21 + n"), ("'last' || k", "function", "26 + n", "26 + n"),
    ), ("'lib.b' || k", "'three'")),
    "go": Sample("src/go/p@K.go", '''package parts

import "fmt"

// Part is { open
type Part@K struct {
	Name string `json:"}"`
}

type (
	alias = int
	Group@K interface{ Do() }
)
type other = string

func New@K[T any](x T) (int, error) {
@FILL
}

func (p *Part@K) Run() error { return fmt.Errorf("}") }
var table = map[string]int{
	"a": 1,
}
''', "\tstep(@I, '}')", (
        ("'Part' || k", "type", "6", "8"), ("'Group' || k", "type", "10", "13"), ("'New' || k", "function", "16", "17 + n"),
        ("'Run'", "method", "19 + n", "19 + n"),
    )),
    "rust": Sample("src/rs/p@K.rs", '''use std::fmt;
pub use crate::b@K::Base;
use std::{io, fs};
/* a /* nested */ brace { */
#[derive(Debug)]
pub struct Part@K<'a> { name: &'a str }
pub(crate) enum Kind@K { A, B }
impl<T: Into<Vec<u8>>> Generic<T> { fn x() {} }
impl fmt::Display for Part@K {
    fn fmt(&self) -> char { '}' }
}
impl Clone for Box<u8> {}
trait Shape@K: Sized { fn area(&self); }
type Short@K = Result<u8, String>;
const LIMIT: u8 = { 1 };
pub const fn grow@K() -> u8 {
@FILL
}
mod inner@K { fn hidden() {} }
struct Unit@K;
''', '    step(@I, r#"}"#);', (
        ("'Part' || k", "struct", "6", "6"), ("'Kind' || k", "struct", "7", "7"), ("'impl Part' || k", "impl", "9", "11"),
        ("'impl Clone'", "impl", "12", "12"), ("'Shape' || k", "trait", "13", "13"), ("'Short' || k", "type", "14", "14"),
        ("'grow' || k", "function", "16", "17 + n"), ("'inner' || k", "function", "18 + n", "18 + n"),
        ("'Unit' || k", "struct", "19 + n", "19 + n"),
    ), ("'std::fmt'", "'crate::b' || k || '::Base'")),
    "php": Sample("src/php/p@K.php", '''<p>{</p>
<?php
namespace Parts;
use Lib\\Base;
// don't stop {
#[Entity(name: 'p@K')]
abstract class Part@K extends Base {
    function run() { return "}"; }
}
interface Shape@K {}
trait Loud@K {}
function make@K($a) {
@FILL
}
$f = function () { return '}'; };
final class Done@K {}
?>
<b>}</b>
<?php
function tail@K() {}
''', "    step(@I, '}'); # }", (
        ("'Part' || k", "class", "6", "9"), ("'Shape' || k", "type", "10", "10"), ("'Loud' || k", "type", "11", "11"),
        ("'make' || k", "function", "12", "13 + n"), ("'Done' || k", "class", "15 + n", "15 + n"),
        ("'tail' || k", "function", "19 + n", "19 + n"),
    )),
    "css": Sample("src/css/p@K.css", '''@import url("a;b.css");
/* } */
.part@K,
a[href="}"] {
@FILL
}
@media (max-width: 9px) { a { b: c } }
@-webkit-keyframes spin@K { from {} to {} }
@font-face { src: url(x) }
#p@K:hover { color: red }
''', "  --v@I: '}';", (
        ("'@import'", "rule", "1", "1"), ("'.part' || k || ',' || chr(10) || 'a[href=\"}\"]'", "rule", "3", "5 + n"),
        ("'@media'", "rule", "6 + n", "6 + n"), ("'@keyframes spin' || k", "rule", "7 + n", "7 + n"),
        ("'#p' || k || ':hover'", "rule", "9 + n", "9 + n"),
    )),
}


def _filled(text: str, filler: str) -> Column:
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.replace(
        F.lit(filler), F.lit("@I"), i.cast("string"))), "\n")
    filled = F.replace(F.replace(F.lit(text), F.lit("@K"), F.col("p_partkey").cast("string")),
                       F.lit("@N"), F.col("p_size").cast("string"))
    return F.replace(filled, F.lit("@FILL"), lines)


def source_files(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """One source file per part in a language, with as many filler lines as the part's size, and at least one."""
    sample = SAMPLES[language]
    parts = spread(table(spark, folder, "part")).withColumn("p_size", F.greatest(F.coalesce("p_size", F.lit(1)), F.lit(1)))
    path = F.replace(F.lit(sample.path), F.lit("@K"), F.col("p_partkey").cast("string"))
    return parts.select(path.alias("file_path"), F.lit("." + sample.path.rsplit(".", 1)[1]).alias("extension"),
                        F.lit("code").alias("category"), _filled(sample.text, sample.filler).alias("content"),
                        F.col("p_partkey").alias("key"))
