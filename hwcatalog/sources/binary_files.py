"""INF and executable files: decoding of unknown encodings, installer kinds, version resources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pe_image

# fixed values: byte signatures of installer kinds, in the order in which they are tried
INSTALLER_SIGNATURES = (
    (b"Nullsoft.NSIS.exehead", "NSIS"), (b"NSIS Error", "NSIS"), (b"\x00Inno Setup Setup Data", "InnoSetup"), (b"Inno Setup Setup Data", "InnoSetup"),
    (b"This installation was built with Inno Setup", "InnoSetup"), (b"7-Zip SFX", "7z-SFX"), (b"7zSD.sfx", "7z-SFX"), (b"WinRAR SFX", "WinRAR-SFX"),
    (b"WiX Burn", "WiX-Bootstrapper"), (b"InstallShield", "InstallShield"), (b"Wise Installation", "WiseSFX"),
)
SEVEN_ZIP = b"7z\xbc\xaf\x27\x1c"
LOOK_AT = 131072


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content, size) of the files below a folder that match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content", F.col("length").alias("size"))


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Text of bytes: by byte order mark, else strict UTF-8, else Windows-1252, else Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if b.startswith(mark):
                return b.decode(name, "replace")
        for name in ("utf-8", "cp1252"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                continue
        return b.decode("latin-1")

    return content.map(one)


@F.pandas_udf(T.StringType())
def _kind(head: pd.Series) -> pd.Series:
    signatures = (*INSTALLER_SIGNATURES, (SEVEN_ZIP, "7z-SFX"))
    return head.map(lambda b: next((name for sig, name in signatures if sig in (b or b"")), "PE-installer"))


def installer_type(content: Column) -> Column:
    """Kind of an executable by the first signature in its head; only the head goes to Python."""
    return _kind(F.substring(content, 1, LOOK_AT))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in pe_image.FIELDS]))
def pe_metadata(content: pd.Series) -> pd.DataFrame:
    """Versions, company, description and the icon's digest of executables, by their resource tree."""
    return pd.DataFrame([pe_image.metadata(b) for b in content], columns=list(pe_image.FIELDS))
