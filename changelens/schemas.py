"""Schemas of the change model and the fixed value tables that go with it."""

from __future__ import annotations

CHANGE = "struct<start:int,end:int,content:string,highlight:string>"
SIDE = f"struct<line_number:int,changes:array<{CHANGE}>>"
ENTRY = f"struct<lhs:{SIDE},rhs:{SIDE}>"
CHUNKS = f"array<array<{ENTRY}>>"
DIFF_RECORD = f"struct<path:string,language:string,status:string,chunks:{CHUNKS}>"

FILES = (
    "path string, language string, status string, is_binary boolean, "
    f"old_content string, new_content string, chunks {CHUNKS}"
)
REGIONS = (
    "path string, side string, start_line bigint, end_line bigint, header_end_line bigint, "
    "node_type string, name string, collapsed boolean, level bigint"
)
COMMENTS = "path string, side string, line_start bigint, line_end bigint, text string"
STAGED_RANGES = "path string, side string, line_start bigint, line_end bigint"

# First letter of a listing line -> file status.
LISTING_STATUS = {
    "M": "modified",
    "A": "added",
    "D": "deleted",
    "R": "renamed",
    "C": "copied",
    "?": "untracked",
}

# Status words of a diff record (anything else is "changed").
RECORD_STATUS = {
    "created": "added",
    "added": "added",
    "deleted": "removed",
    "removed": "removed",
    "unchanged": "unchanged",
}

# Token highlights of a diff record.
HIGHLIGHTS = {
    "normal": "normal",
    "novel": "novel",
    "delimiter": "delimiter",
    "string": "string",
    "type": "type_",
    "comment": "comment",
    "keyword": "keyword",
    "tree_sitter_error": "tree_sitter_error",
}
SEMANTIC_HIGHLIGHTS = ("delimiter", "string", "type_", "comment", "keyword")

# File extension -> language.
EXTENSIONS = {
    "zig": "zig",
    "rs": "rust",
    "py": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "go": "go",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "java": "java",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "sh": "bash",
    "bash": "bash",
}

CATEGORIES = ("comment", "whitespace", "rename", "moved", "semantic")
COSMETIC = ("comment", "whitespace", "rename", "moved")
CHANGE_TYPES = ("added", "modified", "deleted")

# Construct kind -> counter it falls into.
STAT_BUCKETS = {
    "function": "functions",
    "struct_": "structs",
    "enum_": "enums",
    "union_": "unions",
    "test_decl": "tests",
    "class": "other",
    "impl": "other",
    "trait": "other",
    "interface": "other",
    "module": "other",
    "other": "other",
}
BUCKETS = ("functions", "structs", "enums", "unions", "tests", "other")

# Display labels.
NODE_LABELS = {
    "function": "fn",
    "struct_": "struct",
    "enum_": "enum",
    "union_": "union",
    "class": "class",
    "impl": "impl",
    "trait": "trait",
    "interface": "interface",
    "module": "module",
    "test_decl": "test",
    "other": "block",
}
CHANGE_SYMBOLS = {"added": "+", "modified": "~", "deleted": "-"}
CATEGORY_SYMBOLS = {"comment": "💬", "whitespace": "⎵", "rename": "≈", "moved": "→", "semantic": "•"}
COMMENT_LABELS = {
    "line": "line comment",
    "doc": "doc comment",
    "block": "block comment",
    "unknown": "comment",
}

# Node kinds of a grammar that stand for a construct, per language.
CONSTRUCT_NODES = {
    ("zig", "FnProto"): "function",
    ("zig", "fn_decl"): "function",
    ("zig", "Decl"): "function",
    ("zig", "function_declaration"): "function",
    ("zig", "FnDecl"): "function",
    ("zig", "ContainerDecl"): "struct_",
    ("zig", "container_decl"): "struct_",
    ("zig", "struct_declaration"): "struct_",
    ("zig", "container_decl_auto"): "struct_",
    ("zig", "ContainerDeclAuto"): "struct_",
    ("zig", "TestDecl"): "test_decl",
    ("zig", "test_decl"): "test_decl",
    ("zig", "test_declaration"): "test_decl",
    ("zig", "TopLevelDecl"): "other",
    ("zig", "top_level_decl"): "other",
    ("rust", "function_item"): "function",
    ("rust", "struct_item"): "struct_",
    ("rust", "enum_item"): "enum_",
    ("rust", "impl_item"): "impl",
    ("rust", "trait_item"): "trait",
    ("rust", "mod_item"): "module",
    ("python", "function_definition"): "function",
    ("python", "class_definition"): "class",
    ("javascript", "function_declaration"): "function",
    ("javascript", "function"): "function",
    ("javascript", "arrow_function"): "function",
    ("javascript", "method_definition"): "function",
    ("javascript", "class_declaration"): "class",
    ("javascript", "class"): "class",
    ("javascript", "interface_declaration"): "interface",
    ("go", "function_declaration"): "function",
    ("go", "method_declaration"): "function",
    ("go", "type_declaration"): "struct_",
    ("c", "function_definition"): "function",
    ("c", "struct_specifier"): "struct_",
    ("c", "enum_specifier"): "enum_",
    ("c", "union_specifier"): "union_",
    ("c", "class_specifier"): "class",
    ("java", "method_declaration"): "function",
    ("java", "constructor_declaration"): "function",
    ("java", "class_declaration"): "class",
    ("java", "interface_declaration"): "interface",
    ("java", "enum_declaration"): "enum_",
}
# Languages that share another language's node table.
NODE_FAMILY = {"typescript": "javascript", "cpp": "c"}

# Node kinds that hold an identifier.
IDENTIFIER_NODES = (
    "identifier",
    "field_identifier",
    "type_identifier",
    "property_identifier",
    "shorthand_property_identifier",
    "shorthand_property_identifier_pattern",
    "package_identifier",
)

# Node kinds that make a variable declaration a container.
CONTAINER_NODES = (
    "struct_declaration",
    "enum_declaration",
    "union_declaration",
    "error_set_declaration",
    "ContainerDecl",
    "container_decl",
)

# Node kinds and words behind a syntax highlight.
STRING_NODES = (
    "string string_literal interpreted_string_literal raw_string_literal character char_literal rune_literal"
).split()
NUMBER_NODES = "integer float number integer_literal float_literal".split()
TYPE_NODES = "builtin_type primitive_type type_identifier".split()
KEYWORDS = (
    "const var let fn func def pub return if else for while loop do break continue switch match case default "
    "defer try catch throw finally struct enum union class interface trait impl async await import export from "
    "use mod package static extern inline public private protected new this self super as in is not and or "
    "typeof sizeof yield with lambda goto select chan go range mut ref move unsafe where dyn crate comptime "
    "errdefer orelse test error suspend resume nosuspend threadlocal usingnamespace asm volatile allowzero "
    "packed align linksection callconv noinline"
).split()
CONSTANTS = (
    "true false null nil none None True False undefined unreachable null_literal boolean"
).split()
OPERATOR_STARTS = "+-*/%=!<>&|^~?."
PUNCTUATION = "()[]{},;:@#"
