"""The lexer layer: one pass over the texts gives every feature that is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..lex import comments, declarations, dry, fold, functions, imports, units

#: Bytes a core for which a table counts as small.
SMALL_BYTES = 8 << 20

_INT, _STR, _BOOL = pa.int32(), pa.string(), pa.bool_()


def _structs(**kinds: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(kinds.items())))


#: feature -> (Arrow type, Spark type, function of text and extension)
FEATURES = {
    "masked_text": (_STR, "string", comments.mask_comments),
    "masked_literals": (_STR, "string", comments.mask_literals),
    "masked_code": (_STR, "string", lambda text, ext: comments.mask_code(text)),
    "comment_ranges": (_structs(start=_INT, end=_INT, kind=_STR), schema.COMMENT_RANGES, lambda t, e: [{"start": s.start, "end": s.end, "kind": s.kind} for s in comments.comment_ranges(t, e)]),
    "literal_lines": (_structs(starts_inside=_BOOL, ends_inside=_BOOL), "array<struct<starts_inside:boolean,ends_inside:boolean>>", lambda t, e: [{"starts_inside": a, "ends_inside": b} for a, b in comments.literal_lines(t, e)]),
    "function_spans": (_structs(kind=_STR, name=_STR, start_line=_INT, end_line=_INT, line_count=_INT, code_line_count=_INT), schema.FUNCTION_SPANS, functions.function_spans),
    "declarations": (_structs(kind=_STR, name=_STR, line=_INT), schema.DECLARATIONS, declarations.declarations),
    "module_specifiers": (_structs(specifier=_STR, start=_INT, end=_INT, removal_start=_INT, removal_end=_INT), schema.SPECIFIERS, imports.module_specifiers),
    "statement_specifiers": (_structs(specifier=_STR, start=_INT, end=_INT, removal_start=_INT, removal_end=_INT), schema.SPECIFIERS, imports.statement_specifiers),
    "folded_strings": (pa.list_(_STR), "array<string>", fold.folded_strings),
    "imported_names": (pa.list_(_STR), "array<string>", lambda t, e: imports.imported_names(t)),
    "used_identifiers": (pa.list_(_STR), "array<string>", lambda t, e: imports.used_identifiers(t)),
    "dry_descriptors": (_structs(name=_STR, language=_STR, classification=_STR, start_line=_INT, character_count=_INT, fingerprint=_STR), "array<struct<name:string,language:string,classification:string,start_line:int,character_count:int,fingerprint:string>>", dry.descriptors),
    "boundary_edits": (_structs(at_line=_INT, remove_count=_INT, insert_count=_INT), "array<struct<at_line:int,remove_count:int,insert_count:int>>", units.boundary_edits),
    "structural_units": (_structs(scope=_STR, group=_STR, name=_STR, start_line=_INT, end_line=_INT), schema.UNITS, units.structural_units),
}


def spread(files: DataFrame) -> DataFrame:
    """files over all cores, where they are few bytes and so in few partitions.

    Lexing costs far more than moving a small table; a large one has its partitions from the scan.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(cores) if size < cores * SMALL_BYTES else files


def with_features(files: DataFrame, *names: str) -> DataFrame:
    """files with a column per feature; texts that are null have null features.

    A feature that is there already is left alone, so callers may share a pass.
    """
    names = tuple(n for n in dict.fromkeys(names) if n not in files.columns)
    if not names:
        return files
    kinds = [FEATURES[n][0] for n in names]
    out = ",".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields), *(f"`{n}` {FEATURES[n][1]}" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            exts = b.column(b.schema.get_field_index("ext")).to_pylist()
            columns = [pa.array([None if t is None else FEATURES[n][2](t, e or "") for t, e in zip(texts, exts, strict=True)], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *names])

    return spread(files).mapInArrow(run, out)


def exploded(files: DataFrame, feature: str) -> DataFrame:
    """One row per element of a feature: path, ext, ordinal from 0, and the element's fields."""
    f = with_features(files, feature)
    element = F.posexplode(feature).alias("ordinal", "e")
    kind = f.schema[feature].dataType.elementType
    rows = f.select("path", "ext", element)
    return rows.select("path", "ext", "ordinal", "e.*") if hasattr(kind, "fields") else rows.withColumnRenamed("e", "value")


def rewritten(files: DataFrame, change: Callable[[str, str, str], str], exts: Iterable[str]) -> DataFrame:
    """(path, new_text) of the files of those extensions that change(path, text, ext) alters.

    Unchanged texts do not leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, new) for p, t, e in zip(*(c.to_pylist() for c in b.columns), strict=True) if (new := change(p, t, e)) != t]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _STR) for i in (0, 1)], names=["path", "new_text"])

    chosen = files.filter(F.col("ext").isin(list(exts)) & F.col("text").isNotNull()).select("path", "text", "ext")
    return spread(chosen).mapInArrow(run, "path string, new_text string")
