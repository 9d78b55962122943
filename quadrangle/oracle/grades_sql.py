"""Oracle SQL for the grade arithmetic."""

from . import r2

COURSE_AVERAGE = f"""
SELECT etudiant_id, cours_id,
       CASE WHEN SUM(COALESCE(coefficient, 0)) > 0
            THEN {r2('SUM(note * COALESCE(coefficient, 0)) / SUM(COALESCE(coefficient, 0))')}
            ELSE CAST(0 AS DOUBLE) END AS moyenne,
       SUM(COALESCE(coefficient, 0)) AS totalCoefficients,
       COUNT(*) AS nb_notes
FROM notes GROUP BY etudiant_id, cours_id
"""

COURSE_MEANS = f"""
SELECT n.etudiant_id, c.id AS cours_id, c.nom AS cours_nom, c.code AS cours_code, c.credits,
       COALESCE({r2('AVG(n.note * n.coefficient) / NULLIF(AVG(n.coefficient), 0)')},
                CAST(0 AS DOUBLE)) AS moyenne_cours
FROM notes n JOIN cours c ON n.cours_id = c.id
GROUP BY n.etudiant_id, c.id, c.nom, c.code, c.credits
HAVING COUNT(n.id) > 0
"""

GENERAL_AVERAGE = f"""
WITH m AS ({COURSE_MEANS}),
per AS (
  SELECT etudiant_id,
         CAST(SUM(CAST(floor(moyenne_cours * 100 + 0.5) AS BIGINT) * COALESCE(credits, 0)) AS BIGINT) AS tp100,
         CAST(SUM(COALESCE(credits, 0)) AS BIGINT) AS totalCredits
  FROM m GROUP BY etudiant_id),
g AS (
  SELECT etudiant_id,
         CASE WHEN totalCredits > 0
              THEN {r2('CAST(tp100 AS DOUBLE) / CAST(100 AS DOUBLE) / totalCredits')}
              ELSE CAST(0 AS DOUBLE) END AS moyenneGenerale,
         totalCredits
  FROM per)
SELECT e.id AS etudiant_id, g.moyenneGenerale, g.totalCredits
FROM etudiants e LEFT JOIN g ON g.etudiant_id = e.id
"""
