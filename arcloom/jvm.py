"""Functions in Java for what takes too long in Python: compiled by Janino, which every Spark has, and sent to the executors as a jar."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The jar of each source and application.
_JARS: dict[tuple[str, str], str] = {}


def _jar(spark: SparkSession, source: Path) -> str:
    sc = spark.sparkContext
    at = (str(source), sc.applicationId)
    if at not in _JARS:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.read_text())
        path = str(Path(tempfile.mkdtemp(prefix="arcloom-jar-")) / f"{source.stem}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.sc().addJar(path)
        _JARS[at] = path
    return _JARS[at]


def java_function(spark: SparkSession, source: Path, name: str, kind: str, *args: Column | str) -> Column:
    """A call of the class of ``source`` (``arcloom.`` and the file's name, a ``UDFn``) as the function ``name`` with results of type ``kind``."""
    jvm = spark.sparkContext._jvm
    urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(_jar(spark, source)).toURI().toURL()
    loader = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    made = loader.loadClass(f"arcloom.{source.stem}").newInstance()
    spark._jsparkSession.udf().register(name, made, jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    return F.call_function(name, *args)
