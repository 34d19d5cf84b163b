"""The standard library's random choices among many signs, summed in Spark's own JVM, which takes less than half of numpy's time.

The few lines of Java are compiled by Janino, the compiler that Spark brings for its generated code, and given to the executors as a jar.
"""

from __future__ import annotations

import itertools
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from py4j.java_gateway import JavaObject
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = (1 << 31) - 1  # signs: places are ints there

# A number takes two words a, b: ((a >>> 5) * 2**26 + (b >>> 6)) / 2**53, exact in a double; the product with n is rounded as Python's.
SOURCE = """
package lakesieve;

import org.apache.spark.broadcast.Broadcast;
import org.apache.spark.sql.api.java.UDF2;

public class Draws implements UDF2 {
  private Broadcast fours;
  private int n;

  public void among(Broadcast fours, int n) {
    this.fours = fours;
    this.n = n;
  }

  public Object call(Object state, Object replicates) {
    java.nio.ByteBuffer words = java.nio.ByteBuffer.wrap((byte[]) state).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    int[] s = new int[624];
    for (int i = 0; i < 624; i++) s[i] = words.getInt();
    int count = ((Integer) replicates).intValue();
    java.nio.ByteBuffer sums = java.nio.ByteBuffer.allocate(8 * count).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    resample((byte[]) fours.value(), n, s, count, sums);
    return sums.array();
  }

  static void resample(byte[] fours, int n, int[] s, int count, java.nio.ByteBuffer sums) {
    int[] x = new int[227], y = new int[227], z = new int[227], o = new int[227], t = new int[624], places = new int[312];
    double scale = n * (1.0 / (1L << 53));
    int at = 312;
    for (int r = 0; r < count; r++) {
      int left = n;
      long sum = -(long) n;
      while (left > 0) {
        if (at == 312) {
          next(s, x, y, z, o);
          temper(s, t);
          place(t, places, scale);
          at = 0;
        }
        int to = at + Math.min(312 - at, left);
        sum += drawn(fours, places, at, to);
        left -= to - at;
        at = to;
      }
      sums.putLong(sum);
    }
  }

  // the next 624 words; copies are at one place each, as the compiler makes vectors of such loops only
  static void next(int[] s, int[] x, int[] y, int[] z, int[] o) {
    for (int from = 0; from < 623; from += 227) {
      int some = Math.min(227, 623 - from);
      System.arraycopy(s, from, x, 0, some);
      System.arraycopy(s, from + 1, y, 0, some);
      System.arraycopy(s, from == 0 ? 397 : from - 227, z, 0, some);
      mix(x, y, z, o);
      System.arraycopy(o, 0, s, from, some);
    }
    int v = s[623] & 0x80000000 | s[0] & 0x7fffffff;
    s[623] = s[396] ^ v >>> 1 ^ -(v & 1) & 0x9908b0df;
  }

  static void mix(int[] x, int[] y, int[] z, int[] o) {
    for (int i = 0; i < 227; i++) {
      int v = x[i] & 0x80000000 | y[i] & 0x7fffffff;
      o[i] = z[i] ^ v >>> 1 ^ -(v & 1) & 0x9908b0df;
    }
  }

  static void temper(int[] s, int[] t) {
    for (int i = 0; i < 624; i++) {
      int v = s[i];
      v ^= v >>> 11;
      v ^= v << 7 & 0x9d2c5680;
      v ^= v << 15 & 0xefc60000;
      t[i] = v ^ v >>> 18;
    }
  }

  static void place(int[] t, int[] places, double scale) {
    for (int i = 0; i < 312; i++) places[i] = (int) (((long) (t[2 * i] >>> 5) << 26 | t[2 * i + 1] >>> 6) * scale);
  }

  // signs raised to 0, 1 and 2, four to a byte, added up
  static int drawn(byte[] fours, int[] places, int from, int to) {
    int sum = 0;
    for (int i = from; i < to; i++) {
      int p = places[i];
      sum += fours[p >>> 2] >>> ((p & 3) << 1) & 3;
    }
    return sum;
  }
}
"""

_built: tuple[str, JavaObject] | None = None
_number = itertools.count()


def _class(sc: SparkContext) -> JavaObject:
    """The compiled class, its jar given to this application's executors."""
    global _built
    if _built is None or _built[0] != sc.applicationId:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE)
        jar = Path(tempfile.mkdtemp(prefix="lakesieve-")) / "lakesieve-draws.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(str(jar))
        _built = sc.applicationId, compiler.getClassLoader().loadClass("lakesieve.Draws")
    return _built[1]


def broadcast(spark: SparkSession, fours: np.ndarray) -> JavaObject:
    return spark.sparkContext._jsc.broadcast(bytearray(fours))


def summed(begun: DataFrame, shared: JavaObject, n: int) -> DataFrame:
    """sums: those of successive replicates of n signs, four to a byte in shared, as little-endian longs; begun has state, the generator's 624 words before, and replicates, an int."""
    spark, name = begun.sparkSession, f"lakesieve_draws_{next(_number)}"
    own = _class(spark.sparkContext).newInstance()
    own.among(shared, n)
    spark._jsparkSession.udf().register(name, own, spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    out = begun.select(F.call_udf(name, "state", "replicates").alias("sums"))  # holds the function itself from here
    spark.sql(f"DROP TEMPORARY FUNCTION {name}")
    return out
