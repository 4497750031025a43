"""Schemas of the tables and the closed type system of the graph."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Bytes count from 0, ends exclusive; lines count from 1, ends inclusive.
SPAN = struct(start_byte=_L, end_byte=_L, start_line=_L, end_line=_L)
PARSER = struct(name=_S, runtime_version=_S, grammar=_S, grammar_version=_S, extractor_version=_S)
PROVENANCE = struct(source_id=_S, snapshot_id=_S)
FILE = struct(path=_S, name=_S, mime_type=_S, language=_S, size_bytes=_L, provenance=PROVENANCE)
INCLUDE = struct(target=_S, line=_L, span=SPAN, resolution_status=_S)
CLASS = struct(id=_S, name=_S, qualified_name=_S, owner_id=_S, kind=_S, start_line=_L, end_line=_L, span=SPAN)
FUNCTION = struct(id=_S, name=_S, qualified_name=_S, signature=_S, return_type=_S, owner_id=_S, kind=_S, start_line=_L, end_line=_L, span=SPAN)
CALL = struct(id=_S, caller=_S, caller_id=_S, callee=_S, owner_id=_S, expression=_S, line=_L, resolution_status=_S, span=SPAN)
DIAGNOSTIC = struct(kind=_S, message=_S, span=SPAN)
SCOPE = struct(id=_S, kind=_S, name=_S, qualified_name=_S, owner_id=_S, span=SPAN)
SECTION = struct(title=_S, text=_S, start_page=_L, end_page=_L)

CODE_MODEL = struct(
    schema_version=_I, parser=PARSER, parse_status=_S,
    includes=T.ArrayType(INCLUDE), classes=T.ArrayType(CLASS), functions=T.ArrayType(FUNCTION),
    calls=T.ArrayType(CALL), diagnostics=T.ArrayType(DIAGNOSTIC), scopes=T.ArrayType(SCOPE),
)
#: One typed row for each stored file: code files have `code`, documents have `sections`.
MODEL_RECORD = struct(artifact_id=_S, model_type=_S, file=FILE, code=CODE_MODEL, sections=T.ArrayType(SECTION))

NODES = struct(id=_S, type=_S, properties=_S)
EDGES = struct(source=_S, type=_S, target=_S, properties=_S)

# The node types, and for each relation its allowed end types.
NODE_TYPES = ("Repository", "Revision", "File", "Function", "Class", "CallSite")
RELATIONS = (
    ("HAS_REVISION", "Repository", "Revision"),
    ("CONTAINS", "Revision", "File"),
    ("CONTAINS", "File", "CallSite"),
    ("DEFINES", "File", "Function"),
    ("DEFINES", "File", "Class"),
    ("HAS_CALL_SITE", "Function", "CallSite"),
)
RELATION_NAMES = ("CONTAINS", "DEFINES", "HAS_CALL_SITE", "HAS_REVISION")

# Supported extensions with their mime type, language and model type.
EXTENSIONS = {
    ".cpp": ("text/plain", "C++", "code"),
    ".cc": ("text/plain", "C++", "code"),
    ".cxx": ("text/plain", "C++", "code"),
    ".hpp": ("text/plain", "C++", "code"),
    ".h": ("text/plain", "C++", "code"),
    ".c": ("text/plain", "C", "code"),
    ".md": ("text/markdown", None, "document"),
    ".txt": ("text/plain", None, "document"),
}
