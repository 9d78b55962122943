"""Fixture views as SQL text (FIXTURES.md section 2), used only by the DuckDB
oracle: each oracle query inlines the views it reads as CTEs, so it runs
on the driver's base tables alone and shares no code with the Spark side.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "departements": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS nom, r_name AS description
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
    "etudiants": """
SELECT c_custkey AS id, 'ETU-' || CAST(c_custkey AS STRING) AS matricule,
       c_name AS nom, 'P' || CAST(c_custkey % 97 AS STRING) AS prenom,
       'e' || CAST(c_custkey AS STRING) || '@campus.fr' AS email,
       CAST(CASE WHEN c_nationkey >= 23 THEN NULL ELSE c_nationkey END AS BIGINT) AS departement_id,
       c_mktsegment AS niveau, CAST(1 + c_custkey % 5 AS INT) AS annee_etude
FROM customer
""",
    "professeurs": """
SELECT s_suppkey AS id, 'PRF-' || CAST(s_suppkey AS STRING) AS matricule,
       s_name AS nom, 'P' || CAST(s_suppkey % 7 AS STRING) AS prenom,
       'p' || CAST(s_suppkey AS STRING) || '@campus.fr' AS email,
       'SPEC-' || CAST(s_suppkey % 7 AS STRING) AS specialite,
       CASE WHEN s_acctbal < 2500 THEN 'Assistant'
            WHEN s_acctbal < 6000 THEN 'Maitre' ELSE 'Professeur' END AS grade,
       CAST(CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE s_nationkey END AS BIGINT) AS departement_id
FROM supplier
""",
    "cours": """
SELECT p_partkey AS id, 'C-' || CAST(p_partkey AS STRING) AS code, p_name AS nom,
       p_brand AS description, CAST(1 + p_size % 6 AS INT) AS credits,
       p_size AS heures_cours, CAST(p_size % 20 AS INT) AS heures_tp,
       CAST(p_partkey % 25 AS BIGINT) AS departement_id,
       CAST(CASE WHEN p_partkey % 11 = 10 THEN NULL ELSE p_partkey % 10 END AS BIGINT) AS professeur_id,
       p_type AS semestre, p_brand AS annee_academique
FROM part WHERE p_partkey % 50 <> 49
""",
    "inscriptions": """
SELECT etudiant_id, cours_id, MIN(o_orderdate) AS date_inscription, 'active' AS statut
FROM (SELECT o_custkey AS etudiant_id, l_partkey AS cours_id, o_orderdate
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE (o_custkey + l_partkey) % 13 <> 0) x
GROUP BY etudiant_id, cours_id
""",
    "notes": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag)) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey, l_quantity) AS id, o_custkey AS etudiant_id, l_partkey AS cours_id,
       l_returnflag AS type_evaluation, CAST(CAST(l_quantity AS INT) % 21 AS DOUBLE) AS note,
       CAST(l_linenumber % 4 AS DOUBLE) AS coefficient,
       CAST(l_shipdate AS DATE) AS date_evaluation
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "emplois_temps": """
SELECT o_orderkey AS id, o_orderkey % 200 AS cours_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'Lundi' WHEN 1 THEN 'Mardi' WHEN 2 THEN 'Mercredi'
            WHEN 3 THEN 'Jeudi' WHEN 4 THEN 'Vendredi' WHEN 5 THEN 'Samedi' ELSE 'Dimanche' END AS jour,
       CAST(8 + o_custkey % 10 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ':00' ELSE ':30' END AS heure_debut,
       CAST(9 + o_custkey % 10 + o_orderkey % 3 % 2 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ':00' ELSE ':30' END AS heure_fin,
       'S' || CAST(o_orderkey % 500 AS STRING) AS salle,
       CASE o_orderkey % 4 WHEN 0 THEN 'cours' WHEN 1 THEN 'tp' WHEN 2 THEN 'td' ELSE 'examen' END AS type_seance
FROM orders
""",
    "absences": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag)) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey, l_quantity) AS id, o_custkey AS etudiant_id, l_partkey AS cours_id,
       CAST(l_shipdate AS DATE) AS date_absence,
       CASE WHEN l_tax = 0 THEN NULL ELSE o_orderpriority END AS motif,
       l_linestatus = 'F' AS justifiee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
""",
    "bills": """
SELECT o_orderkey AS id, 'FAC-' || CAST(o_orderkey AS STRING) AS invoiceNumber,
       o_custkey AS studentId, o_totalprice AS amount, o_orderpriority AS description,
       CAST(o_orderdate AS DATE) AS issueDate,
       CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'pending' END AS status
FROM orders
""",
    "payments": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag)) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey, l_quantity) AS id, 'PAY-' || CAST(((l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag)) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey, l_quantity) AS STRING) AS paymentNumber,
       l_orderkey AS billId, o_custkey AS studentId, l_extendedprice AS amount,
       l_returnflag AS method, CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
""",
    "expenses": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag)) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey, l_quantity) AS id, 'EXP-' || CAST(((l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag)) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey, l_suppkey, l_quantity) AS STRING) AS expenseNumber,
       l_returnflag AS description, l_extendedprice AS amount, l_returnflag AS category,
       CAST(l_suppkey % 27 AS BIGINT) AS departmentId, 'S' || CAST(l_suppkey AS STRING) AS supplier,
       CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'pending' END AS status
FROM lineitem WHERE l_linenumber = 2
""",
    "teaching_staff": """
SELECT s_suppkey AS id, 'ENS-' || CAST(s_suppkey AS STRING) AS employeeId,
       s_name AS lastName, 'F' || CAST(s_suppkey % 7 AS STRING) AS firstName,
       CAST(CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE s_nationkey END AS BIGINT) AS departmentId,
       CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'inactive' END AS status
FROM supplier
""",
    "admin_staff": """
SELECT c_custkey AS id, 'ADM-' || CAST(c_custkey AS STRING) AS employeeId,
       c_name AS lastName, 'F' || CAST(c_custkey % 7 AS STRING) AS firstName,
       CAST(CASE WHEN c_custkey % 17 = 16 THEN NULL ELSE c_nationkey END AS BIGINT) AS departmentId,
       CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'inactive' END AS status
FROM customer WHERE c_custkey % 10 = 0
""",
    "demandes_bourse": """
SELECT c_custkey AS id, c_name AS nom, 'P' || CAST(c_custkey % 97 AS STRING) AS prenoms,
       c_mktsegment AS serieBac, CAST(c_custkey % 21 AS DOUBLE) AS moyenneBac,
       CASE WHEN c_acctbal < -500 THEN 'Acceptée' ELSE 'En attente' END AS statut
FROM customer WHERE c_acctbal < 0
""",
}
