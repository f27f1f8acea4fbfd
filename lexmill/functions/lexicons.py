"""Term lists and ordered rules, as data."""

DOCUMENT_TYPES = [
    ("INSTRUCTION", ["cbi-", "i-20", "instruction"]),
    ("REGLEMENT", ["rglt", "cbr-", "r-20", "reglement"]),
    ("CODE_PENAL", ["pénal", "penal", "code"]),
    ("DECISION", ["dcobac", "dec-", "decision"]),
    ("LETTRE_CIRCULAIRE", ["circulaire", "lettre", "lc-"]),
]
LEGAL_TERMS = ["article", "bancaire", "cemac", "chapitre", "cobac", "commission", "instruction", "règlement", "section", "titre"]
ACCEPTANCE_TERMS = ["adopte", "article", "cemac", "chapitre", "cobac", "commission bancaire", "decide", "instruction", "règlement", "vu"]
CRITICAL = ["amende", "criminel", "dissolution", "emprisonnement", "fermeture", "pénal", "retrait d'agrément", "suspension"]
HIGH = ["blanchiment", "capital", "compliance", "gouvernance", "interdiction", "limite", "obligation", "prudentiel", "pénalité", "ratio", "risque", "sanction", "systémique", "terrorisme"]
EXPORT_HIGH = ["amende", "capital", "doit", "délai", "fonds propres", "immédiat", "interdit", "limite", "maximum", "minimum", "obligation", "pénalité", "ratio", "retrait", "révocation", "sanction", "suspension"]
EXPORT_MEDIUM = ["communication", "devrait", "déclaration", "information", "notification", "peut", "procédure", "rapport", "recommandé"]
REQUIREMENT = ["doit", "obligation", "exigence", "requis", "nécessaire"]
PENALTY = ["sanction", "pénalité", "amende", "suspension", "retrait", "révocation"]
THEMES = {
    "capital": ["capital", "fonds propres", "equity"],
    "risk": ["risque", "risk", "exposition"],
    "governance": ["gouvernance", "conseil", "board", "dirigeant"],
    "compliance": ["conformité", "compliance", "respect"],
    "reporting": ["rapport", "reporting", "déclaration"],
    "penalties": ["sanction", "pénalité", "amende"],
    "liquidity": ["liquidité", "liquidity", "trésorerie"],
    "audit": ["audit", "contrôle interne", "vérification"],
}
ACCURACY_TERMS = ["cemac", "cobac", "commission bancaire", "fonds propres", "instruction", "ratio de solvabilité", "règlement", "surveillance", "établissement de crédit"]
MISSPELT = ["ariicle", "commision", "regiement"]
ARTICLE_WORDS = ["autorisation", "doit", "doivent", "est", "interdiction", "obligation", "peut", "peuvent", "sont"]
OBLIGATION = ["doit", "doivent", "exigé", "interdit", "nécessaire", "obligation", "obligé", "prohibé", "requis", "respecter", "tenu de"]
SANCTION = ["amende", "emprisonnement", "infraction", "peine", "punissable", "pénalité", "révocation", "sanction", "suspension"]
IMPACT_HIGH = ["capital", "crédit", "fonds propres", "liquidité", "provisions", "ratio", "risque", "réserves", "solvabilité", "surveillance"]
IMPACT_MEDIUM = ["audit", "communication", "contrôle interne", "déclaration", "gouvernance", "information", "reporting"]
TECHNICAL = ["capital", "liquidité", "provisions", "ratio", "solvabilité"]
CATEGORIES = [
    ("I", 1.0, ["organisation", "administration", "siège", "commission bancaire", "secrétariat"]),
    ("II", 1.0, ["dispositions générales", "définition", "champ d'application", "objet"]),
    ("III", 1.2, ["agrément", "autorisation", "dirigeants", "commissaires aux comptes", "licence"]),
    ("IV", 1.5, ["plan comptable", "comptabilité", "états financiers", "bilan", "comptable"]),
    ("V", 1.3, ["paiement", "monnaie électronique", "virement", "carte", "systèmes de paiement"]),
    ("VI", 1.2, ["prudentiel", "ratio", "solvabilité", "fonds propres", "normes prudentielles", "capital"]),
    ("VII", 1.4, ["contrôle interne", "audit", "conformité", "blanchiment"]),
    ("VIII", 1.1, ["groupe", "consolid", "holding", "filiale"]),
    ("IX", 1.2, ["clientèle", "consommateur", "tarif", "réclamation"]),
]
CATEGORY_NAMES = {"I": "ORGANISATION", "II": "GENERAL", "III": "LICENSING", "IV": "ACCOUNTING", "V": "PAYMENTS", "VI": "PRUDENTIAL", "VII": "CONTROL", "VIII": "GROUPS", "IX": "CONSUMERS"}
OCR_RULES = [(r"\bl(?=\d)", "1"), (r"(?<=\d)O", "0"), (r"(\d),(\d)", "$1.$2"), (r"\bArtic1e\b", "Article"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
ORDINALS = ["premier", "deuxième", "troisième", "quatrième", "cinquième", "sixième", "septième", "huitième", "neuvième", "dixième"]
CONFLICTS = [("modification", "conformity"), ("exception", "conformity"), ("modification", "application")]
PLACEHOLDERS = ["non disponible", "non spécifié", "à analyser", "à compléter", "à identifier", "à évaluer"]
