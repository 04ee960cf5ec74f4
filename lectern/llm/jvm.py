"""Functions of our own that run in the JVM, beside the built-in ones: a Java source in this folder, compiled by Janino,
the compiler that Spark itself uses for its generated code.

The classes are put into a jar in the shared folder, which executors fetch like any other; a lost executor's successor
fetches it again.  Nothing has to be built or installed beforehand.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from lectern.llm.common import shared_dir


def register(spark: SparkSession, source: str, functions: dict[str, tuple[str, str]]) -> None:
    """functions: SQL name -> (class, type of the result).  Does nothing if the session has them."""
    if all(spark.catalog.functionExists(name) for name in functions):
        return
    text = Path(__file__).with_name(source).read_text()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(text)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as jar:
        for name, code in compiler.getBytecodes().items():
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lectern/{Path(source).stem}-{hashlib.sha256(text.encode()).hexdigest()[:16]}.jar")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{spark.sparkContext.applicationId}")
        out = files.create(part)
        out.write(packed.getvalue())
        out.close()
        if not files.rename(part, path):  # another application was first
            files.delete(part, False)
    spark._jsc.addJar(files.makeQualified(path).toString())
    loader = compiler.getClassLoader()
    for name, (kind, result) in functions.items():
        function = loader.loadClass(kind).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(name, function, spark._jsparkSession.parseDataType(f'"{result}"'))
