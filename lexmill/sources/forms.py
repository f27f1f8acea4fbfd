"""Regulation texts in every form that the operators know, derived from orders by one SQL text for Spark and DuckDB.

One row is one order: a file name, a title, a reference and a summary, a text as a bad scan gives it, and a document whose articles, headings, dates and
citations take each form in turn. Only integers and strings take part, so both engines give the same characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pick(key: str, options: list[str]) -> str:
    """A CASE over the remainder of a key; options are SQL expressions or quoted texts."""
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options[:-1])) + f" ELSE {options[-1]} END"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CODES = ["2016/04", "98/01", "2019/01", "93/05", "2020/06", "2008/01", "2009/01", "1999/77", "2010/02", "2020/03", "2003/04"]
_LC = "LC/131 aux dirigeants"
_REFERENCE = _pick("k", [f"concat('Règlement COBAC R-', {_pick('k / 10', [_q(c) for c in _CODES])})", _q("Instruction COBAC I-2016/03"), _q("Décision COBAC D-2010/004"), _q("Règlement N° 02/15/CEMAC/UMAC/COBAC"), _q("Règlement n° 04/03/CEMAC/UMAC/COBAC"), _q("Règlement N° 01/15/CEMAC/UMAC/COBAC"), _q(_LC), _q("Convention portant harmonisation de la réglementation bancaire de 1992"), _q("Note interne"), _q("Décision COBAC D-99/99")])
_TITLES = [
    "VI. NORMES PRUDENTIELLES applicables aux banques", "IV - REGLEMENTATION COMPTABLE des assujettis", "relatif au plan comptable et à la publication des comptes", "Agrément unique et installation des banques",
    "Services de paiement des prestataires", "Relations avec la clientèle et taux d'usure", "5 mesures de surveillance", "VII - CONTRÔLE DES ETABLISSEMENTS assujettis", "lutte contre le blanchiment et le terrorisme",
    "Ratios de liquidité et transformation", "Garantie des dépôts : fonds de garantie", "X. TRAITEMENT DES BANQUES EN DIFFICULTE", "Change et transferts en devises", "Reporting des états CERBER", "Commissaires aux comptes", "Fonds propres et capital minimum", "Texte sans indice",
]
_SUMMARIES = [
    "Fixe le ratio de solvabilité et les fonds propres. Section 3 du recueil.", "Définit le plan comptable et le bilan.", "Traite du contrôle interne et de l'audit.", "Organise le virement et le chèque.", "Précise la licence bancaire.", "Protège le consommateur et ses réclamations.",
    "Encadre la consolidation du groupe bancaire.", "Règle l'organisation de la Commission.", "Résumé non disponible", "à compléter", "Partie XI. Marché monétaire et titres publics.",
]
_NOISY = [
    "Aiticle 12 O l du texte.La banque verse 3,5 %", "ARIICLE 4 de la   Commission   Bancaire sur les Fonds  Propres", "TITRE IV : Normes du C0BAC et de la CEMAO", "Art.7 CHAPITRE II. Dispositions du 3 - 4 - 2019", "Le créd1t vaut 12 % soit 500FCFA ; l'articl0 5 , est clos",
    "Artlcle 9 SECT1ON II t1tre 0/00 et 0 m rn", "Article 3 : Objet\nCOBAC R-2016 04 a) Premier cas .Suite", "coooooool ## @@ ~~ bruit", "CHAPTTRE IV fin.Nouveau paragraphe sans accent, 15° jour", "ariicle 8 AIT. 6 établissement  de  crédit",
]
_FILES = ["cobac2021_recueil.pdf", "plan_comptable_R-98.pdf", "systeme_paiement_2019-02.pdf", "R-2016_ratio.pdf", "controle_interne_R-2008.pdf", "holding_1.pdf", "protection_client.pdf", "agrement_R-2001.pdf", "statuts_cobac.pdf", "notes_2020-03.pdf", "divers.pdf"]
_HEADS = [
    "COMMISSION BANCAIRE DE L'AFRIQUE CENTRALE\nRèglement COBAC R-2016/04 relatif au contrôle interne des établissements de crédit\n",
    "CEMAC\nInstruction COBAC I-2016/03 portant conditions de présentation\nObjet : forme des dossiers d'agrément\n", "COBAC\nDécision COBAC D-2010/04 du 12/03/2010\n", "UMAC\nRèglement n° 01/20/CEMAC/UMAC/COBAC relatif à la protection de la clientèle\n",
    "Note sans en-tête\nTexte portant sur divers points de la pratique des banques\n", "COBAC\nRèglement N° 02/15/CEMAC/UMAC/CM modifiant certains textes\n", "Convention du 16 octobre 1990 entre les membres\n",
]
_DATES = ["Entrée en vigueur le 01/07/2016.\n", "Applicable à compter du 15-02-2019.\n", "Prend effet au 1/1/2020.\n", "Fait en l'an 2015.\n", "Du 3 avril 2014.\n"]
#: Articles in each form; each body has more than 50 characters but for the last.
_FORMS = [
    "Article {n} : Du capital minimum\nLes banques tiennent un capital qui couvre leurs risques en toute circonstance.\n", "Article {n} bis - Des réserves\nLes réserves légales sont constituées chaque année avant toute distribution.\n",
    "Article {n},5 Des provisions\nLes provisions couvrent les créances douteuses selon le calendrier fixé plus haut.\n", "Article {n} (nouveau) : Du contrôle\nLe contrôle porte sur les opérations de toute nature et sur leur enregistrement.\n",
    "{n} - Des seuils\nLes seuils sont fixés par la Commission après avis du comité de surveillance.\n", "Art. {n} COBAC : Des délais\nLes délais courent du jour de la notification faite aux dirigeants responsables.\n",
    "REGLE {n} : De la preuve\nLa preuve des dépôts est apportée par tout moyen écrit que la loi reconnaît.\n", "ARTICLE {n}\nDes sanctions\nLes manquements exposent leurs auteurs aux sanctions prévues par la convention.\n",
    "Article deuxième : De la forme\nLes dossiers sont déposés en trois exemplaires auprès du secrétariat général.\n", "Le compte divisionnaire « {n}-1 » Pertes\nLe compte enregistre les pertes constatées à la clôture de chaque exercice.\n",
    "L'article {n} dispose : la règle suivante\nLes garanties reçues ne sont comptées qu'une fois dans le calcul des ratios.\n", "R {n} - Du registre\nLe registre est tenu à jour et il est présenté à toute réquisition des agents.\n", "Article {n} : Abrogé.\n",
]
_CITES = [
    "Conformément aux articles 2 à 4, le seuil est dû.", "Conformément à l'article 3,5 et 6 le calcul est fait.", "En vertu des articles 7 les agents visitent.", "Selon les dispositions de l'article 8 il est tenu.", "Au sens de l'article 9 la banque est agréée.",
    "Les cas prévus aux articles 10 sont traités.", "Le texte modifie l'article 2.", "Il remplace l'article 3.", "Il abroge l'article 4.", "Il complète l'article 5.", "Voir l'article 6.", "Cf. l'article 7.", "Se référer à l'article 8.", "Terme défini à l'article 9.",
    "En application de l'article 2 du texte.", "Aux fins de l'article 3 du texte.", "Par dérogation à l'article 4, la règle cède.", "Nonobstant l'article 5, elle cède.", "Sauf disposition contraire de l'article 6, elle vaut.", "À l'exception de l'article 7, elle vaut.",
    "In accordance with article 2 it holds.", "Pursuant to articles 3 it holds.", "As per article 4 it holds.", "Banks under article 5 report.", "It amends article 6.", "It replaces article 7.", "It repeals article 8.", "See article 9.", "Refer to article 10.", "Terms as defined in article 11 apply.", "Le Règlement COBAC n° R-2016/04 et Bâle III s'ajoutent au Code de commerce.", "La Loi n° 12 du pays et le Traité CEMAC valent.",
]


def _body(key: str, number: str, forms: list[str]) -> str:
    return _pick(key, ["concat(" + ", ".join(_q(p) if i % 2 == 0 else number for i, p in enumerate(x.replace("{n}", "\0n\0").split("\0"))) + ")" if "{n}" in x else _q(x) for x in forms])


def forms_sql(orders: str = "orders", string: str = "VARCHAR") -> str:
    """The CTE ``forms`` (doc_id, file_name, title, reference, summary, noisy, txt, page_count), after WITH."""
    cast = lambda x: f"CAST({x} AS {string})"
    articles = [_body(f"(k + {5 * i})", cast(str(i + 1)), _FORMS) for i in range(4)]
    cites = [_pick(f"(k + {11 * i})", [_q(x + "\n") for x in _CITES]) for i in range(4)]
    parts = [_pick("k", list(map(_q, _HEADS))), _q("VU la convention du 16 octobre 1992 ;\n\n"), _pick("k", [_q("DECIDE :\nce qui suit pour les banques.\n"), _q("")])]
    for i in range(4):
        parts += ["CASE WHEN k % 3 = 0 THEN 'TITRE II - Des règles\n' ELSE '' END"] * (i == 2) + [articles[i], cites[i]]
    parts += ["CASE WHEN k % 4 = 0 THEN '\n| Seuil | Taux |\n| 10 | 5 % |\n| 20 | 7 % |\n| total | 12 % |\n\n' ELSE '' END", _pick("k", list(map(_q, _DATES))), "CASE WHEN k % 2 = 0 THEN '\n\nFait à Yaoundé\nLe Président, M. Essono\n' ELSE '\nPour le Secrétaire Général, Mme Obame\n' END"]
    # integer division differs between the engines, so remainders do it
    text = f"""forms AS (SELECT k AS doc_id, {_pick('k', list(map(_q, _FILES)))} AS file_name, {_pick('k', list(map(_q, _TITLES)))} AS title, {_REFERENCE.replace('k / 10', 'CAST((k - k % 10) / 10 AS BIGINT)')} AS reference, {_pick('k', list(map(_q, _SUMMARIES)))} AS summary, {_pick('k', list(map(_q, _NOISY)))} AS noisy,
concat({', '.join(parts)}) AS txt, CAST(k % 7 AS INT) AS page_count FROM (SELECT o_orderkey AS k FROM {orders}) o)"""
    return text


def forms_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, title, reference, summary, noisy, txt, page_count) of a directory with orders.parquet."""
    # keys are spread before texts are made of them: what follows runs on all cores, and whatever goes by document needs no other shuffle
    n = spark.conf.get("spark.sql.shuffle.partitions")
    orders = f"(SELECT /*+ REPARTITION({n}, o_orderkey) */ o_orderkey FROM parquet.`{sf_dir}/orders.parquet`)"
    return spark.sql(f"WITH {forms_sql(orders, 'STRING')} SELECT * FROM forms")
