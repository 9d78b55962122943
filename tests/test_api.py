"""Library entry points not registered as queries: overview dicts, per-id
pages, the remaining W1 variants, deletes by pair, sinks and plan helpers."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from quadrangle.operators import changes, listing, reports
from quadrangle.plans.inspect import pushed_filters, unscalable_nodes

AS_OF = dt.datetime(2024, 5, 1)


def test_overviews_are_consistent(campus):
    c = campus
    ov = {
        "students": reports.students_overview(c.departements, c.etudiants),
        "professors": reports.professors_overview(c.departements, c.professeurs),
        "courses": reports.courses_overview(c.departements, c.cours),
        "grades": reports.grades_overview(c.notes),
        "sessions": reports.sessions_overview(c.emplois_temps),
        "absences": reports.absences_overview(c.absences, c.cours),
        "departments": reports.departments_overview(c.departements, c.etudiants,
                                                    c.professeurs, c.cours),
    }
    n = ov["students"]["total"].first()["count"]
    assert sum(r["count"] for r in ov["students"]["parNiveau"].collect()) == n
    g = ov["grades"]["totals"].first()
    assert sum(r["count"] for r in ov["grades"]["repartition"].collect()) == g["count"]
    a = ov["absences"]["totals"].first()
    assert a["justifiees"] + a["nonJustifiees"] <= a["total"]
    rep = ov["departments"]["repartition"].collect()
    assert [r.nb_etudiants for r in rep] == sorted((r.nb_etudiants for r in rep), reverse=True)
    assert len(ov["absences"]["parMois"].collect()) <= 12


def test_per_id_pages(campus):
    c = campus
    d = listing.department_students(c.etudiants, c.departements, 3)
    tot = c.etudiants.filter(F.col("departement_id") == 3).count()
    assert d.pagination.first()["total"] == tot
    assert d.rows.count() == min(20, tot)
    assert all(r.departement_id == 3 for r in d.rows.collect())
    p = listing.department_professors(c.professeurs, c.departements, 3)
    assert p.pagination.first()["total"] == c.professeurs.filter("departement_id = 3").count()
    k = listing.department_courses(c.cours, c.departements, c.professeurs, 3)
    assert k.pagination.first()["total"] == c.cours.filter("departement_id = 3").count()
    sid = c.absences.select("etudiant_id").first()[0]
    sa = listing.student_absences(c.absences, c.cours, sid, justifiee=None)
    assert sa.pagination.first()["total"] == c.absences.filter(F.col("etudiant_id") == sid).count()
    assert all(r.etudiant_id == sid for r in sa.rows.collect())


def test_remaining_appends(spark):
    depts = spark.createDataFrame([(1, "Informatique")], "id long, nom string")
    batch = spark.createDataFrame([(1, "Physique", None), (2, "Informatique", "x"),
                                   (3, "", None)], "seq long, nom string, description string")
    cs = changes.add_departments(depts, batch, as_of=AS_OF)
    assert {r.seq: r.reason for r in cs.report.collect()} == {1: None, 2: "doublon",
                                                             3: "invalide"}
    courses = spark.createDataFrame([(1, "C-1")], "id long, code string")
    cb = spark.createDataFrame([(1, "C-2", "Algo", "3", "10", "2", "1", "S1", "2024"),
                                (2, "C-1", "Algo", "3", "10", "2", "1", "S1", "2024"),
                                (3, "C-3", "Algo", "0", "10", "2", "1", "S1", "2024")],
                               "seq long, code string, nom string, credits string, "
                               "heures_cours string, heures_tp string, departement_id string, "
                               "semestre string, annee_academique string")
    cc = changes.add_courses(courses, cb, as_of=AS_OF)
    assert {r.seq: r.reason for r in cc.report.collect()} == {1: None, 2: "doublon",
                                                             3: "invalide"}
    profs = spark.createDataFrame([], "id long, matricule string, email string")
    pb = spark.createDataFrame([(1, "P-1", "N", "P", "p@x.fr", "1", "Algo", "MCF")],
                               "seq long, matricule string, nom string, prenom string, "
                               "email string, departement_id string, specialite string, "
                               "grade string")
    assert changes.add_professors(profs, pb, as_of=AS_OF).accepted.first().id == 1
    notes = spark.createDataFrame([(7, 1, 10)], "id long, etudiant_id long, cours_id long")
    nb = spark.createDataFrame([(1, "1", "10", "CC", "12", "1", "2024-01-01")],
                               "seq long, etudiant_id string, cours_id string, "
                               "type_evaluation string, note string, coefficient string, "
                               "date_evaluation string")
    g = changes.add_grades(notes, nb, spark.createDataFrame([(1,)], "id long"),
                           spark.createDataFrame([(10,)], "id long"),
                           spark.createDataFrame([(1, 10)], "etudiant_id long, cours_id long"),
                           as_of=AS_OF)
    r = g.accepted.first()
    assert (r.id, r.note, r.date_evaluation) == (8, 12.0, dt.date(2024, 1, 1))


def test_delete_enrolments_and_json_sink(spark):
    enrol = spark.createDataFrame([(1, 1, 10), (2, 1, 11)], "id long, etudiant_id long, "
                                                            "cours_id long")
    cs = changes.delete_enrolments(enrol, spark.createDataFrame(
        [(1, 10), (5, 5)], "etudiant_id long, cours_id long"))
    assert [r.id for r in cs.table.collect()] == [2]
    assert [(r.etudiant_id, r.reason) for r in cs.rejected.collect()] == [(5, "introuvable")]
    out = os.path.join(tempfile.mkdtemp(prefix="quad-json-"), "rows")
    changes.to_json(cs.table, out)
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json")
             for x in open(os.path.join(out, f))]
    assert lines == [{"id": 2, "etudiant_id": 1, "cours_id": 11}]
    path = changes.write_version(cs.table, os.path.dirname(out), "inscriptions", "1")
    assert spark.read.parquet(path).count() == 1


def test_plan_helpers(spark, campus):
    df = campus.notes.filter(F.col("type_evaluation") == "A")
    assert unscalable_nodes(df) == []
    assert any("EqualTo(l_returnflag,A)" in f for f in pushed_filters(df))


def test_per_id_pages_equal_plain_sorted_joins(campus):
    c = campus
    sid = c.absences.groupBy("etudiant_id").count().orderBy(F.desc("count"), "etudiant_id") \
        .first()["etudiant_id"]
    got = [r.id for r in listing.student_absences(c.absences, c.cours, sid, limit=5).rows
           .collect()]
    full = (c.absences.filter(F.col("etudiant_id") == sid)
            .join(c.cours.select(F.col("id").alias("cours_id")), "cours_id")
            .orderBy(F.col("date_absence").desc_nulls_last(), "id").select("id").limit(5))
    assert got == [r.id for r in full.collect()]
    d = listing.department_students(c.etudiants, c.departements, 3, limit=7).rows.collect()
    want = (c.etudiants.filter("departement_id = 3").orderBy("nom", "prenom", "id")
            .limit(7).collect())
    assert [r.id for r in d] == [r.id for r in want]
    assert all(r.departement_nom is not None for r in d)
