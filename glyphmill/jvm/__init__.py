"""Unicode and locale functions that run in the JVM on the library that ships with Spark.

The Java sources beside this file are compiled once per content into a small jar, which Spark hands to its executors.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

_SOURCES = sorted(Path(__file__).parent.glob("*.java"))
_FUNCTIONS = (("glyphmill_text", "TextFn", StringType()), ("glyphmill_list", "ListFn", ArrayType(StringType())), ("glyphmill_bytes", "BytesFn", BinaryType()))


def _build_jar() -> Path:
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in _SOURCES)).hexdigest()[:16]
    jar = Path(tempfile.gettempdir()) / f"glyphmill-{digest}.jar"
    if jar.is_file() and jar.stat().st_uid == os.getuid():  # not one that another user has put there
        return jar
    compiler = shutil.which("javac") or os.path.join(os.environ.get("JAVA_HOME", ""), "bin", "javac")
    if not os.path.exists(compiler):
        raise RuntimeError("the locale functions need a Java compiler on the driver (javac, or JAVA_HOME of a JDK)")
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "*")
    with tempfile.TemporaryDirectory() as out:
        subprocess.run([compiler, "-nowarn", "--release", "17", "-cp", jars, "-d", out, *map(str, _SOURCES)], check=True, capture_output=True)
        part = jar.with_suffix(f".{os.getpid()}")
        with zipfile.ZipFile(part, "w") as packed:
            for p in sorted(Path(out).rglob("*.class")):
                packed.write(p, p.relative_to(out).as_posix())
        os.replace(part, jar)
    return jar


def register(spark: SparkSession | None = None) -> None:
    """Make the functions known to the session, once."""
    spark = spark or SparkSession.active()
    if spark.catalog.functionExists("glyphmill_text"):
        return
    spark.sql(f"ADD JAR '{_build_jar()}'")
    for name, kind, returns in _FUNCTIONS:
        spark.udf.registerJavaFunction(name, f"glyphmill.{kind}", returns)


def _call(function: str, name: str, args: tuple) -> Column:
    register()
    values = [a if isinstance(a, Column) else F.lit(str(a)) for a in args]
    return F.call_function(function, F.lit(name), F.array(*[v.cast("string") for v in values]) if values else F.array().cast("array<string>"))


def text(name: str, *args) -> Column:
    return _call("glyphmill_text", name, args)


def array(name: str, *args) -> Column:
    return _call("glyphmill_list", name, args)


def binary(name: str, *args) -> Column:
    return _call("glyphmill_bytes", name, args)
