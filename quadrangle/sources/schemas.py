"""Fixed table definitions (S2) and insert defaults (S3).

Every entity has one ``StructType``; nothing is inferred.  Keys are
``long``, measures ``int``/``double``, calendar dates ``date`` and
insertion instants ``timestamp``.  Clock times (``heure_debut``,
``heure_fin``) stay text: the stored form ``H:MM`` / ``HH:MM`` is what the
conflict rule compares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
DT, TS, B = T.DateType(), T.TimestampType(), T.BooleanType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "departements": _struct(("id", L), ("nom", S), ("description", S), ("directeur_id", L),
                            ("created_at", TS)),
    "etudiants": _struct(("id", L), ("matricule", S), ("nom", S), ("prenom", S), ("email", S),
                         ("telephone", S), ("date_naissance", DT), ("adresse", S),
                         ("departement_id", L), ("niveau", S), ("annee_etude", I),
                         ("user_id", L), ("created_at", TS)),
    "professeurs": _struct(("id", L), ("matricule", S), ("nom", S), ("prenom", S), ("email", S),
                           ("telephone", S), ("specialite", S), ("grade", S),
                           ("departement_id", L), ("user_id", L), ("created_at", TS)),
    "cours": _struct(("id", L), ("code", S), ("nom", S), ("description", S), ("credits", I),
                     ("heures_cours", I), ("heures_tp", I), ("departement_id", L),
                     ("professeur_id", L), ("semestre", S), ("annee_academique", S),
                     ("created_at", TS)),
    "inscriptions": _struct(("id", L), ("etudiant_id", L), ("cours_id", L),
                            ("date_inscription", T.TimestampNTZType()), ("statut", S)),
    "notes": _struct(("id", L), ("etudiant_id", L), ("cours_id", L), ("type_evaluation", S),
                     ("note", D), ("coefficient", D), ("date_evaluation", DT),
                     ("commentaire", S), ("created_at", TS)),
    "emplois_temps": _struct(("id", L), ("cours_id", L), ("jour", S), ("heure_debut", S),
                             ("heure_fin", S), ("salle", S), ("type_seance", S),
                             ("created_at", TS)),
    "absences": _struct(("id", L), ("etudiant_id", L), ("cours_id", L), ("date_absence", DT),
                        ("motif", S), ("justifiee", B), ("created_at", TS)),
    "bills": _struct(("id", L), ("invoiceNumber", S), ("studentId", L), ("amount", D),
                     ("description", S), ("dueDate", DT), ("issueDate", DT), ("status", S),
                     ("created_at", TS)),
    "payments": _struct(("id", L), ("paymentNumber", S), ("billId", L), ("studentId", L),
                        ("amount", D), ("method", S), ("reference", S), ("date", DT),
                        ("status", S), ("created_at", TS)),
    "expenses": _struct(("id", L), ("expenseNumber", S), ("description", S), ("amount", D),
                        ("category", S), ("departmentId", L), ("supplier", S), ("date", DT),
                        ("status", S), ("created_at", TS)),
    "teaching_staff": _struct(("id", L), ("employeeId", S), ("firstName", S), ("lastName", S),
                              ("email", S), ("phone", S), ("departmentId", L), ("position", S),
                              ("specialization", S), ("hireDate", DT), ("education", S),
                              ("status", S), ("created_at", TS)),
    "admin_staff": _struct(("id", L), ("employeeId", S), ("firstName", S), ("lastName", S),
                           ("email", S), ("phone", S), ("departmentId", L), ("position", S),
                           ("hireDate", DT), ("responsibilities", S), ("education", S),
                           ("status", S), ("created_at", TS)),
    "demandes_bourse": _struct(("id", L), ("nom", S), ("prenoms", S), ("telephone", S),
                               ("email", S), ("serieBac", S), ("moyenneBac", D), ("statut", S),
                               ("dateSoumission", TS)),
}

TABLES = tuple(SCHEMAS)

# Primary key and UNIQUE columns of each table (fixed values of the schema).
PRIMARY_KEY = {name: "id" for name in SCHEMAS}
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "etudiants": [("matricule",), ("email",)],
    "professeurs": [("matricule",), ("email",)],
    "cours": [("code",)],
    "inscriptions": [("etudiant_id", "cours_id")],
    "bills": [("invoiceNumber",)],
    "payments": [("paymentNumber",)],
    "expenses": [("expenseNumber",)],
    "teaching_staff": [("employeeId",), ("email",)],
    "admin_staff": [("employeeId",), ("email",)],
}
# Foreign keys of each table, by column (fixed values of the schema).  Parents
# stand before their children in this order, so one pass goes down all levels.
FOREIGN_KEYS: dict[str, dict[str, str]] = {
    "departements": {},
    "etudiants": {"departement_id": "departements"},
    "professeurs": {"departement_id": "departements"},
    "cours": {"departement_id": "departements", "professeur_id": "professeurs"},
    "inscriptions": {"etudiant_id": "etudiants", "cours_id": "cours"},
    "notes": {"etudiant_id": "etudiants", "cours_id": "cours"},
    "emplois_temps": {"cours_id": "cours"},
    "absences": {"etudiant_id": "etudiants", "cours_id": "cours"},
    "bills": {"studentId": "etudiants"},
    "payments": {"billId": "bills", "studentId": "etudiants"},
    "expenses": {"departmentId": "departements"},
    "teaching_staff": {"departmentId": "departements"},
    "admin_staff": {"departmentId": "departements"},
}
# Columns declared NOT NULL (besides the key).
NOT_NULL: dict[str, tuple[str, ...]] = {
    "departements": ("nom",),
    "etudiants": ("matricule", "nom", "prenom", "email"),
    "professeurs": ("matricule", "nom", "prenom", "email"),
    "cours": ("code", "nom"),
    "notes": ("type_evaluation", "note"),
    "emplois_temps": ("jour", "heure_debut", "heure_fin"),
    "absences": ("date_absence",),
    "bills": ("invoiceNumber", "amount"),
    "payments": ("paymentNumber", "amount"),
    "expenses": ("expenseNumber", "description", "amount"),
    "teaching_staff": ("employeeId", "firstName", "lastName", "email"),
    "admin_staff": ("employeeId", "firstName", "lastName", "email"),
    "demandes_bourse": ("nom", "prenoms", "telephone", "email", "serieBac", "moyenneBac"),
}


def _defaults(now: Column, today: Column) -> dict[str, dict[str, Column]]:
    # Fixed default values of the table definitions.
    return {
        "departements": {"created_at": now},
        "etudiants": {"created_at": now},
        "professeurs": {"created_at": now},
        "cours": {"created_at": now},
        "inscriptions": {"date_inscription": now.cast(T.TimestampNTZType()),
                         "statut": F.lit("active")},
        "notes": {"coefficient": F.lit(1.0), "created_at": now},
        "emplois_temps": {"type_seance": F.lit("cours"), "created_at": now},
        "absences": {"justifiee": F.lit(False), "created_at": now},
        "bills": {"issueDate": today, "status": F.lit("pending"), "created_at": now},
        "payments": {"date": today, "status": F.lit("completed"), "created_at": now},
        "expenses": {"date": today, "status": F.lit("pending"), "created_at": now},
        "teaching_staff": {"status": F.lit("active"), "created_at": now},
        "admin_staff": {"status": F.lit("active"), "created_at": now},
        "demandes_bourse": {"statut": F.lit("En attente"), "dateSoumission": now},
    }


def conform(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto the fixed schema of ``name``: known columns are cast,
    missing ones become typed NULLs, unknown ones are dropped (except those
    in ``keep``).  Unused NULL columns cost nothing - column pruning removes
    them from the plan."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in SCHEMAS[name].fields
    ] + [F.col(k) for k in keep if k in have and k not in SCHEMAS[name].fieldNames()])


def with_defaults(df: DataFrame, name: str, as_of=None, keep: tuple[str, ...] = ()
                  ) -> DataFrame:
    """S3: fill the declared defaults where a value is absent (NULL).

    ``as_of`` pins "now" (a ``datetime``) for reproducible runs; otherwise the
    query's own ``current_timestamp()`` is used, as the database would.
    Columns in ``keep`` (e.g. the batch ``seq``) are carried after the
    table's columns."""
    now = F.lit(as_of).cast(T.TimestampType()) if as_of is not None else F.current_timestamp()
    today = now.cast(T.DateType())
    df = conform(df, name, keep)
    fills = _defaults(now, today).get(name, {})
    return df.select([
        (F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c)) for c in df.columns
    ])


def typed(df: DataFrame, name: str) -> DataFrame:
    """Cast the columns of ``df`` that belong to table ``name`` to their
    declared types with ``try_cast`` (malformed text -> NULL instead of an
    ANSI error; validation has already flagged it).  Dates also accept the
    ``YYYY/MM/DD`` form the validator accepts; other columns pass through."""
    types = {f.name: f.dataType for f in SCHEMAS[name].fields}
    out = []
    for c, t in df.dtypes:
        want = types.get(c)
        if want is None or t == want.simpleString():
            out.append(F.col(c))
        elif isinstance(want, T.DateType) and t == "string":
            out.append(F.try_to_date(F.regexp_replace(F.col(c), "/", "-"), "yyyy-MM-dd")
                       .alias(c))
        else:
            out.append(F.col(c).try_cast(want).alias(c))
    return df.select(out)
