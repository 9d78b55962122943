"""Fixture adapter: derives the campus tables from the driver's TPC-H-style
parquet files (mapping given in FIXTURES.md section 2).

Each entity is a lazy DataFrame over the source parquet scans, so Catalyst
prunes columns and pushes the fixture filters into the scans.  Nothing is
cached or collected; the two fact tables that need ``orders`` (grades,
absences, payments, enrolments) join ``lineitem`` to ``orders`` on
``orderkey`` - a shuffle (sort-merge) join at scale, a broadcast only when
AQE measures the ``orders`` side as small at run time.  The number of its
tasks goes by the lines, so that what a task sorts and groups is bounded
however large the tables are.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import SCHEMAS, conform

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the fixture mapping: weekday names by o_orderkey % 7 and
# session types by o_orderkey % 4.
WEEKDAYS = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
SESSION_TYPES = ["cours", "tp", "td", "examen"]

#: Lines that a task of the join with ``orders`` gets.  AQE goes by the bytes
#: of compressed shuffle files, of which 64 MB may hold millions of lines.
LINES_PER_TASK = 300_000
#: Fewer tasks than these are left to AQE.
LEAST_TASKS = 8
#: Up to this number Spark writes a shuffle without holding its rows
#: (``spark.shuffle.sort.bypassMergeThreshold``); beyond it tasks first get more
#: lines each.
UNBUFFERED_TASKS = 200
MOST_LINES_PER_TASK = 1_200_000


def _s(c: Column) -> Column:
    return c.cast("string")


def _line_id() -> Column:
    """Unique id of a lineitem row: its order, line number and return flag,
    and its place among the lines that share these.  Holds orders up to
    9 * 10^12 and 999 such lines.  The window runs within an order, on the
    partitioning of the join with ``orders``; it is pruned where no id is
    read, and filters on the flag still reach the scan."""
    same = Window.partitionBy("l_orderkey", "l_linenumber", "l_returnflag").orderBy("l_partkey", "l_suppkey", "l_quantity")
    head = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.ascii("l_returnflag")
    return head * 1000 + F.row_number().over(same)


def _case_index(key: Column, names: list[str]) -> Column:
    out = None
    for i, n in enumerate(names):
        out = F.when(key == i, F.lit(n)) if out is None else out.when(key == i, F.lit(n))
    return out


class Campus:
    """Lazy campus tables over one directory of driver parquet files."""

    def __init__(self, spark: SparkSession, src_dir: str):
        self.spark = spark
        self.src_dir = src_dir.rstrip("/")

    def src(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.src_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(f"unknown table {name!r}")
        return getattr(self, name)

    # -- dimensions ---------------------------------------------------------
    @cached_property
    def departements(self) -> DataFrame:
        n, r = self.src("nation"), self.src("region")
        df = n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_name").alias("nom"), F.col("r_name").alias("description"))
        return conform(df, "departements")

    @cached_property
    def etudiants(self) -> DataFrame:
        c = self.src("customer")
        k = F.col("c_custkey")
        df = c.select(
            k.alias("id"), F.concat(F.lit("ETU-"), _s(k)).alias("matricule"),
            F.col("c_name").alias("nom"), F.concat(F.lit("P"), _s(k % 97)).alias("prenom"),
            F.concat(F.lit("e"), _s(k), F.lit("@campus.fr")).alias("email"),
            F.when(F.col("c_nationkey") >= 23, F.lit(None))
             .otherwise(F.col("c_nationkey")).cast("bigint").alias("departement_id"),
            F.col("c_mktsegment").alias("niveau"),
            (1 + k % 5).cast("int").alias("annee_etude"))
        return conform(df, "etudiants")

    def _grade(self) -> Column:
        return (F.when(F.col("s_acctbal") < 2500, "Assistant")
                .when(F.col("s_acctbal") < 6000, "Maitre").otherwise("Professeur"))

    def _supplier_dept(self) -> Column:
        return (F.when(F.col("s_suppkey") % 17 == 16, F.lit(None))
                .otherwise(F.col("s_nationkey")).cast("bigint"))

    @cached_property
    def professeurs(self) -> DataFrame:
        k = F.col("s_suppkey")
        df = self.src("supplier").select(
            k.alias("id"), F.concat(F.lit("PRF-"), _s(k)).alias("matricule"),
            F.col("s_name").alias("nom"), F.concat(F.lit("P"), _s(k % 7)).alias("prenom"),
            F.concat(F.lit("p"), _s(k), F.lit("@campus.fr")).alias("email"),
            F.concat(F.lit("SPEC-"), _s(k % 7)).alias("specialite"),
            self._grade().alias("grade"), self._supplier_dept().alias("departement_id"))
        return conform(df, "professeurs")

    @cached_property
    def cours(self) -> DataFrame:
        k = F.col("p_partkey")
        df = self.src("part").filter(k % 50 != 49).select(
            k.alias("id"), F.concat(F.lit("C-"), _s(k)).alias("code"),
            F.col("p_name").alias("nom"), F.col("p_brand").alias("description"),
            (1 + F.col("p_size") % 6).cast("int").alias("credits"),
            F.col("p_size").alias("heures_cours"),
            (F.col("p_size") % 20).cast("int").alias("heures_tp"),
            (k % 25).cast("bigint").alias("departement_id"),
            F.when(k % 11 == 10, F.lit(None)).otherwise(k % 10).cast("bigint")
             .alias("professeur_id"),
            F.col("p_type").alias("semestre"), F.col("p_brand").alias("annee_academique"))
        return conform(df, "cours")

    # -- facts over lineitem x orders ------------------------------------------
    @cached_property
    def _line_tasks(self) -> int:
        """Tasks for all lines; their number stands in the files' footers."""
        lines = self.src("lineitem").count()
        return max(min(-(-lines // LINES_PER_TASK), UNBUFFERED_TASKS), -(-lines // MOST_LINES_PER_TASK))

    def _lines(self, line_filter: Column | None = None, line_cols=(), order_cols=()) -> DataFrame:
        li = self.src("lineitem")
        if line_filter is not None:
            li = li.filter(line_filter)
        li = li.select("l_orderkey", *line_cols)
        o = self.src("orders").select("o_orderkey", *order_cols)
        if self._line_tasks > LEAST_TASKS:
            li = li.repartition(self._line_tasks, "l_orderkey")
            o = o.repartition(self._line_tasks, "o_orderkey")
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    _ID_COLS = ("l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_returnflag")

    @cached_property
    def inscriptions(self) -> DataFrame:
        j = self._lines(None, ("l_partkey",), ("o_custkey", "o_orderdate"))
        j = j.filter((F.col("o_custkey") + F.col("l_partkey")) % 13 != 0)
        df = (j.groupBy(F.col("o_custkey").alias("etudiant_id"),
                        F.col("l_partkey").alias("cours_id"))
              .agg(F.min("o_orderdate").alias("date_inscription"))
              .withColumn("statut", F.lit("active")))
        return conform(df, "inscriptions")

    @cached_property
    def notes(self) -> DataFrame:
        j = self._lines(None, self._ID_COLS + ("l_shipdate",), ("o_custkey",))
        df = j.withColumn("_line", _line_id()).select(
            F.col("_line").alias("id"), F.col("o_custkey").alias("etudiant_id"),
            F.col("l_partkey").alias("cours_id"), F.col("l_returnflag").alias("type_evaluation"),
            (F.col("l_quantity").cast("int") % 21).cast("double").alias("note"),
            (F.col("l_linenumber") % 4).cast("double").alias("coefficient"),
            F.col("l_shipdate").cast("date").alias("date_evaluation"))
        return conform(df, "notes")

    @cached_property
    def emplois_temps(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        mins = F.when(k % 2 == 0, F.lit(":00")).otherwise(F.lit(":30"))
        df = self.src("orders").select(
            k.alias("id"), (k % 200).alias("cours_id"),
            _case_index(k % 7, WEEKDAYS).alias("jour"),
            F.concat(_s(8 + c % 10), mins).alias("heure_debut"),
            F.concat(_s(9 + c % 10 + k % 3 % 2), mins).alias("heure_fin"),
            F.concat(F.lit("S"), _s(k % 500)).alias("salle"),
            _case_index(k % 4, SESSION_TYPES).alias("type_seance"))
        return conform(df, "emplois_temps")

    @cached_property
    def absences(self) -> DataFrame:
        j = self._lines(F.col("l_returnflag") == "R",
                        self._ID_COLS + ("l_shipdate", "l_tax", "l_linestatus"),
                        ("o_custkey", "o_orderpriority"))
        df = j.withColumn("_line", _line_id()).select(
            F.col("_line").alias("id"), F.col("o_custkey").alias("etudiant_id"),
            F.col("l_partkey").alias("cours_id"),
            F.col("l_shipdate").cast("date").alias("date_absence"),
            F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
             .alias("motif"),
            (F.col("l_linestatus") == "F").alias("justifiee"))
        return conform(df, "absences")

    @cached_property
    def bills(self) -> DataFrame:
        k = F.col("o_orderkey")
        df = self.src("orders").select(
            k.alias("id"), F.concat(F.lit("FAC-"), _s(k)).alias("invoiceNumber"),
            F.col("o_custkey").alias("studentId"), F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("description"),
            F.col("o_orderdate").cast("date").alias("issueDate"),
            F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending").alias("status"))
        return conform(df, "bills")

    @cached_property
    def payments(self) -> DataFrame:
        j = self._lines(F.col("l_linenumber") == 1,
                        self._ID_COLS + ("l_extendedprice", "l_shipdate",
                                         "l_linestatus"), ("o_custkey",))
        df = j.withColumn("_line", _line_id()).select(
            F.col("_line").alias("id"), F.concat(F.lit("PAY-"), _s(F.col("_line"))).alias("paymentNumber"),
            F.col("l_orderkey").alias("billId"), F.col("o_custkey").alias("studentId"),
            F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("method"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"))
        return conform(df, "payments")

    @cached_property
    def expenses(self) -> DataFrame:
        li = self.src("lineitem").filter(F.col("l_linenumber") == 2)
        df = li.withColumn("_line", _line_id()).select(
            F.col("_line").alias("id"), F.concat(F.lit("EXP-"), _s(F.col("_line"))).alias("expenseNumber"),
            F.col("l_returnflag").alias("description"), F.col("l_extendedprice").alias("amount"),
            F.col("l_returnflag").alias("category"),
            (F.col("l_suppkey") % 27).cast("bigint").alias("departmentId"),
            F.concat(F.lit("S"), _s(F.col("l_suppkey"))).alias("supplier"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(F.col("l_linestatus") == "F", "approved").otherwise("pending").alias("status"))
        return conform(df, "expenses")

    @cached_property
    def teaching_staff(self) -> DataFrame:
        k = F.col("s_suppkey")
        df = self.src("supplier").select(
            k.alias("id"), F.concat(F.lit("ENS-"), _s(k)).alias("employeeId"),
            F.col("s_name").alias("lastName"), F.concat(F.lit("F"), _s(k % 7)).alias("firstName"),
            self._supplier_dept().alias("departmentId"),
            F.when(F.col("s_acctbal") > 0, "active").otherwise("inactive").alias("status"))
        return conform(df, "teaching_staff")

    @cached_property
    def admin_staff(self) -> DataFrame:
        k = F.col("c_custkey")
        df = self.src("customer").filter(k % 10 == 0).select(
            k.alias("id"), F.concat(F.lit("ADM-"), _s(k)).alias("employeeId"),
            F.col("c_name").alias("lastName"), F.concat(F.lit("F"), _s(k % 7)).alias("firstName"),
            F.when(k % 17 == 16, F.lit(None)).otherwise(F.col("c_nationkey")).cast("bigint")
             .alias("departmentId"),
            F.when(F.col("c_acctbal") > 0, "active").otherwise("inactive").alias("status"))
        return conform(df, "admin_staff")

    @cached_property
    def demandes_bourse(self) -> DataFrame:
        k = F.col("c_custkey")
        df = self.src("customer").filter(F.col("c_acctbal") < 0).select(
            k.alias("id"), F.col("c_name").alias("nom"),
            F.concat(F.lit("P"), _s(k % 97)).alias("prenoms"),
            F.col("c_mktsegment").alias("serieBac"), (k % 21).cast("double").alias("moyenneBac"),
            F.when(F.col("c_acctbal") < -500, "Acceptée").otherwise("En attente").alias("statut"))
        return conform(df, "demandes_bourse")


def fixture_campus(spark: SparkSession, src_dir: str) -> Campus:
    return Campus(spark, src_dir)
