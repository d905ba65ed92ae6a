"""Table schemas and enumerations of the catalog and the content store."""

from __future__ import annotations

from pyspark.sql import types as T

# File kinds by extension, needed for equal results.
CODE = (
    "rs py js ts tsx jsx c cpp cc h hpp go java kt kts swift rb php cs scala clj ex exs erl hs ml mli lua r jl sh bash zsh fish ps1 bat cmd pl pm "
    "v sv vhd vhdl zig nim d dart elm vue svelte astro sql graphql gql proto thrift asm s m mm f90 f95 f03 cob cbl ada adb ads"
).split()
IMAGE = "png jpg jpeg gif bmp tiff tif webp svg ico heic heif avif raw cr2 nef arw dng psd ai eps".split()
DOCUMENT = "pdf doc docx xls xlsx ppt pptx odt ods odp rtf tex latex epub".split()
VIDEO = "mp4 mkv avi mov wmv flv webm m4v mpg mpeg 3gp ogv".split()
AUDIO = "mp3 wav flac aac ogg wma m4a opus aiff ape alac".split()
DATA = "csv tsv json jsonl ndjson xml parquet arrow ipc avro feather hdf5 h5 sqlite db pickle pkl npy npz mat".split()
CONFIG = "toml yaml yml ini cfg conf config env properties plist editorconfig prettierrc eslintrc babelrc".split()
TEXT = "md markdown rst txt text log readme changelog license licence authors contributors todo notes org adoc asciidoc wiki".split()
KINDS = {"code": CODE, "image": IMAGE, "document": DOCUMENT, "video": VIDEO, "audio": AUDIO, "data": DATA, "config": CONFIG, "text": TEXT}
OTHER = "other"

# Extensions that are binary besides images, video and audio.
BINARY = "exe dll so dylib bin o a class pyc pyo wasm zip gz bz2 xz zst tar rar 7z jar war parquet arrow ipc avro sqlite db pickle pkl npy npz hdf5 h5".split()

# The coarser classifier, used where single files are read; what is in no list is text.
MEDIA_IMAGE = "png jpg jpeg gif webp bmp tiff tif svg heif heic avif".split()
MEDIA_VIDEO = "mp4 mkv avi mov wmv flv webm m4v mpg mpeg 3gp ogv".split()
MEDIA_AUDIO = "mp3 wav flac aac ogg m4a wma opus".split()
MEDIA_DOCUMENT = "pdf doc docx odt pptx odp xlsx ods".split()
MEDIA_CODE = "py rs js ts go c cpp h java rb sh toml yaml yml".split()

# Language names by extension, case-sensitive.
LANGUAGES = {
    "rust": ["rs"], "python": ["py"], "javascript": ["js", "jsx"], "typescript": ["ts", "tsx"], "c": ["c"], "cpp": ["cpp", "cc", "cxx"],
    "c/cpp": ["h", "hpp"], "go": ["go"], "java": ["java"], "kotlin": ["kt", "kts"], "swift": ["swift"], "ruby": ["rb"], "php": ["php"],
    "csharp": ["cs"], "scala": ["scala"], "shell": ["sh", "bash", "zsh"], "sql": ["sql"], "html": ["html", "htm"],
    "css": ["css", "scss", "sass", "less"], "json": ["json"], "yaml": ["yaml", "yml"], "toml": ["toml"], "xml": ["xml"],
    "markdown": ["md", "markdown"], "dart": ["dart"], "r": ["r"], "julia": ["jl"], "lua": ["lua"], "zig": ["zig"], "nim": ["nim"],
    "elixir": ["ex", "exs"], "erlang": ["erl"], "haskell": ["hs"], "vue": ["vue"], "svelte": ["svelte"],
}

# Prefixes of reference ids by kind.
REF_PREFIXES = {"image": "img", "video": "vid", "audio": "aud", "document": "doc", "code": "code", "data": "data", "config": "cfg", "text": "txt", "other": "obj"}
ROLES = ("system", "developer", "user")
MODES = ("metadata", "fast", "accurate")


def _fields(spec: str, nullable: bool) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampNTZType()}
    return [T.StructField(name, kinds[kind], nullable) for name, kind in (x.split(":") for x in spec.split())]


#: One row per file as a scan gives it: 14 columns.
FILES = T.StructType(_fields("path:s name:s stem:s ext:s size:l modified:t created:t mime:s kind:s is_binary:b depth:i parent:s", False) + _fields("width:i height:i", True))
CONTENT = "content_hash:s text_preview:s language:s dimensions:s magic_mime:s exif_camera:s exif_date:s exif_gps:s exif_orientation:s video_codec:s audio_codec:s line_count:l word_count:l pages:l duration_s:d fps:d has_audio:b phash:s"
#: With the 18 columns that extraction fills in.
EXTENDED = T.StructType(FILES.fields + _fields(CONTENT, True))
#: As stored: keyed by uri, times in epoch microseconds, flags as 0 and 1.
STORED = T.StructType(
    _fields("uri:s name:s stem:s ext:s mime:s kind:s parent:s size:l modified:l created:l is_binary:i depth:i", False)
    + _fields("width:i height:i", True)
    + _fields(CONTENT.replace("has_audio:b", "has_audio:i"), True)
    + _fields("session_id:s ref_id:s", True)
    + _fields("indexed_at:l", False)
    + _fields("content_indexed_at:l", True)
)
CONTENT_COLUMNS = [x.split(":")[0] for x in CONTENT.split()]
EXTRACTIONS = T.StructType(_fields("id:s file_uri:s content_hash:s profile:s model:s mode:s detail:i extra:s summary:s", False) + _fields("metadata:s", True) + _fields("created_at:l", False))
CHUNKS = T.StructType(_fields("id:l", False) + _fields("extraction_id:s", True) + _fields("file_uri:s content_hash:s profile:s model:s mode:s chunk_idx:i chunk_text:s created_at:l", False))
VECTORS = T.StructType([T.StructField("chunk_id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()), False)])
TABLES = {"files": STORED, "extractions": EXTRACTIONS, "chunks": CHUNKS, "chunks_vec": VECTORS}
KEYS = {"files": "uri", "extractions": "id", "chunks": "id", "chunks_vec": "chunk_id"}
