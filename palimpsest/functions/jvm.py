"""Functions that run in the JVM: Spark's own Java compiler makes one jar of their sources once per application, and
Spark hands that to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name -> (class, source, type of the result, whether Spark may evaluate it twice)
_FUNCTIONS: dict[str, tuple[str, str, str, bool]] = {}
_known: set[tuple[str, int]] = set()


def add(name: str, cls: str, source: str, kind: str, again: bool = True) -> None:
    """Names a function. ``again`` = False: it is costly, and filters on it aren't pushed below it, which would evaluate it
    once more."""
    _FUNCTIONS[name] = cls, source, kind, again


def _registered(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId, id(spark._jsparkSession)
    if app in _known:
        return
    from palimpsest.functions import documents, lexical, text, vectors  # noqa: F401  (each names its functions)
    from palimpsest.operators import assignment  # noqa: F401

    jvm = spark._jvm
    compiler = getattr(jvm, "org.codehaus.janino.SimpleCompiler")()
    compiler.cook("\n".join(dict.fromkeys(source for _, source, _, _ in _FUNCTIONS.values())))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="palimpsest-jar-"))
    path = os.path.join(folder, "palimpsest.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    spark.sql(f"ADD JAR '{path}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for name, (cls, _, kind, again) in _FUNCTIONS.items():
        made, of = loader.loadClass(cls).newInstance(), jvm.org.apache.spark.sql.types.DataType.fromDDL(kind)
        if again:
            spark._jsparkSession.udf().register(name, made, of)
        else:  # by its class, as py4j takes the overload for any object
            takes = spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 2)
            takes[0], takes[1] = made.getClass().getInterfaces()[0], jvm.java.lang.Class.forName("org.apache.spark.sql.types.DataType")
            given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 2)
            given[0], given[1] = made, of
            found = jvm.java.lang.Class.forName("org.apache.spark.sql.functions").getMethod("udf", takes).invoke(None, given)
            spark._jsparkSession.udf().register(name, found.asNondeterministic())
    _known.add(app)


def call(name: str, *args: Column) -> Column:
    _registered(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    return F.call_function(name, *args)
