"""The arithmetic of the attention model in the executors' JVMs, on Spark's own vector module.

``Attention.java`` is compiled by the driver's JDK once an application and goes to
the executors as a jar.  Where the driver has no compiler, or no module or
processor for vectors of eight numbers, there is none, and numpy does the same.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from importlib.resources import files

import numpy as np
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession

MODULE = "jdk.incubator.vector"
# For each application, and the folders of their jars, kept as long as this process.
_LOADERS: dict[str, JavaObject | None] = {}
_FOLDERS: list[tempfile.TemporaryDirectory] = []


class Vectors:
    """Training and scores of a model in the JVM; its classes come from ``loader``."""

    def __init__(self, spark: SparkSession, loader: JavaObject):
        self.spark, self.loader = spark, loader

    def _new(self, name: str, model, stored_as: type) -> JavaObject:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        made = self.loader.loadClass(f"lintlake.Attention${name}").getConstructor(
            gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        tree = model.tree
        made.model(
            model.table().astype("<f4").tobytes(), tree.start.astype("<i4").tobytes(), tree.nodes.astype("<i4").tobytes(),
            tree.side.astype("<f4").tobytes(), len(model.p["embed"]), np.dtype(stored_as).itemsize)
        return made

    def moves(self, kinds: DataFrame, model, stored_as: type, rate: float, seed: int, batch: int, most: int, schema: str) -> DataFrame:
        """What training in the tasks does to the rows of the model's table, for the texts in the only column of ``kinds``."""
        made, jvm = self._new("Train", model, stored_as), self.spark._jvm
        state, half = np.random.default_rng(seed).bit_generator.state["state"], 1 << 64
        made.steps(most, batch, rate, *(
            jvm.java.lang.Long.parseUnsignedLong(str(v)) for n in ("state", "inc") for v in divmod(state[n], half)))
        shape = self.spark._jsparkSession.parseDataType(self.spark.createDataFrame([], schema).schema.json())
        return DataFrame(kinds._jdf.mapPartitions(made, jvm.org.apache.spark.sql.Encoders.row(shape)), self.spark)

    def score(self, kinds: str, model, stored_as: type) -> Column:
        """Natural logarithms of the probabilities of the texts in a column."""
        from pyspark.sql.classic.column import _to_java_column, _to_seq

        double = self.spark._jsparkSession.parseDataType('"double"')
        made = self.spark._jvm.org.apache.spark.sql.functions.udf(self._new("Score", model, stored_as), double)
        return Column(made.apply(_to_seq(self.spark.sparkContext, [kinds], _to_java_column)))


def _loader(spark: SparkSession) -> JavaObject | None:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    modules = jvm.java.lang.ModuleLayer.boot()
    if not all(modules.findModule(m).isPresent() for m in (MODULE, "jdk.compiler")):
        return None
    _FOLDERS.append(tempfile.TemporaryDirectory(prefix="lintlake-"))
    folder = os.path.realpath(_FOLDERS[-1].name)
    with open(f"{folder}/Attention.java", "wb") as out:
        out.write(files(__package__).joinpath("Attention.java").read_bytes())

    def array(kind, *values):
        made = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            made[i] = v
        return made

    said = jvm.java.io.StringWriter()
    if jvm.com.sun.tools.javac.Main.compile(array(
            jvm.java.lang.String, "--add-modules", MODULE, "-proc:none", "-cp", jvm.java.lang.System.getProperty("java.class.path"),
            "-d", f"{folder}/classes", f"{folder}/Attention.java"), jvm.java.io.PrintWriter(said)):
        raise RuntimeError(f"Attention.java: {said.toString()}")
    jar = f"{folder}/lintlake-attention.jar"
    with zipfile.ZipFile(jar, "w") as out:
        for name in sorted(os.listdir(f"{folder}/classes/lintlake")):
            out.write(f"{folder}/classes/lintlake/{name}", f"lintlake/{name}")
    loader = jvm.java.net.URLClassLoader(
        array(jvm.java.net.URL, jvm.java.io.File(jar).toURI().toURL()), jvm.java.lang.Thread.currentThread().getContextClassLoader())
    usable = loader.loadClass("lintlake.Attention").getMethod("usable", array(jvm.java.lang.Class))
    if not usable.invoke(None, array(jvm.java.lang.Object)):
        return None
    spark.sparkContext._jsc.addJar(f"file:{jar}")
    return loader


def vectors(spark: SparkSession) -> Vectors | None:
    """The model's arithmetic in the JVM, if the driver can make it."""
    application = spark.sparkContext.applicationId
    if application not in _LOADERS:
        _LOADERS[application] = _loader(spark)
    return Vectors(spark, _LOADERS[application]) if _LOADERS[application] else None
