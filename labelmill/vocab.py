"""Fixed vocabularies of the label domain.

Everything in this module is a fixed value: the results of the classifiers,
matchers and rankers are defined by these lists and by their order.
"""

from __future__ import annotations

# --- Fixed values: dosage form keywords, tested as substrings in this order --

EXCLUDED_FORMS = [
    "capsule, liquid filled",
    "tablet, film coated",
    "tablet, coated",
    "capsule",
    "tablet",
    "kit",
    "injection",
    "injectable",
    "infusion",
    "ophthalmic",
    "otic",
    "nasal",
    "topical",
    "cutaneous",
    "vaginal",
    "rectal",
    "inhalation",
    "nebulizer",
    "irrigation",
]

STRONG_FORMS = [
    "oral solution",
    "oral suspension",
    "oral drops",
    "solution",
    "suspension",
    "syrup",
    "elixir",
    "concentrate",
]

AMBIGUOUS_FORMS = ["emulsion", "liquid", "drops"]

# --- Fixed values: route keywords, tested as substrings in this order --------

ORAL_ROUTES = [
    "oral",
    "sublingual",
    "buccal",
    "oropharyngeal",
    "enteral",
    "nasogastric",
    "gastric",
]

EXCLUDED_ROUTES = [
    "intravenous",
    "intramuscular",
    "subcutaneous",
    "intradermal",
    "intrathecal",
    "intravitreal",
    "intravesical",
    "intraarticular",
    "injection",
    "injectable",
    "infusion",
    "ophthalmic",
    "otic",
    "nasal",
    "topical",
    "cutaneous",
    "vaginal",
    "rectal",
    "inhalation",
    "nebulizer",
    "irrigation",
    "transdermal",
    "percutaneous",
]

# --- Fixed values: sugar alcohol concepts and their aliases ------------------

PIPELINE_CONCEPTS = {
    "sorbitol": [
        "noncrystallizing sorbitol solution",
        "non-crystallizing sorbitol solution",
        "non crystallizing sorbitol solution",
        "sorbitol solution",
        "d-sorbitol",
        "glucitol",
        "sorbitol",
    ],
    "mannitol": ["d-mannitol", "mannitol"],
    "xylitol": ["xylitol"],
    "maltitol": ["maltitol solution", "maltitol syrup", "maltitol"],
    "lactitol": ["lactitol monohydrate", "lactitol"],
    "isomalt": ["isomalt"],
}

APP_CONCEPTS = {
    **PIPELINE_CONCEPTS,
    "glycerin": [
        "2-propanol, 1,3-dihydroxy-",
        "1,2,3-trihydroxypropane",
        "synthetic glycerine",
        "1,2,3-propanetriol",
        "vegetable glycerin",
        "vegetable glycerol",
        "synthetic glycerol",
        "trihydroxypropane",
        "glycerin [hsdb]",
        "glycerin [usp]",
        "glycerin [jan]",
        "glycerol [inn]",
        "fema no. 2525",
        "glycerine",
        "fema 2525",
        "glycerol",
        "glycerin",
        "e-422",
        "e422",
    ],
    "polyethylene glycol": ["polyethylene glycol", "macrogol"],
}

HIGH_CONCEPTS = ["sorbitol", "mannitol"]

REVIEW_REASON = {
    "pipeline": "Ambiguous dosage form with no recorded administration route",
    "app": "Ambiguous dosage form with no recorded route",
}

# --- Fixed values: excipient name canonicalisation ---------------------------
# Applied in this order to lower-cased, punctuation-free text.

CANONICAL_REWRITES = [
    (r"\bfd\s*(?:&|and)\s*c\b", "fdc"),
    (r"\bd\s*(?:&|and)\s*c\b", "dc"),
    (r"\bglycerol\b", "glycerin"),
    (r"\banhydrous glycerin\b", "glycerin"),
    (r"\bpolyethylene glycol\b", "peg"),
    (r"\bmacrogol\b", "peg"),
    (r"\bd[\s-]+sorbitol\b", "sorbitol"),
    (r"\bd[\s-]+mannitol\b", "mannitol"),
    (r"\bnon[\s-]*crystallizing sorbitol solution\b", "sorbitol solution"),
    (r"\bhydrogenated maltose syrup\b", "maltitol"),
    (r"\bmaltitol syrup\b", "maltitol"),
    (r"\bmaltitol solution\b", "maltitol"),
    (r"\blactitol monohydrate\b", "lactitol"),
    (r"\bisomaltitol\b", "isomalt"),
    (r"\bpolyethylene glycol\b", "peg"),
    (r"\bpropylene glycol solution\b", "propylene glycol"),
]

REMOVABLE_PHRASES = [
    " aluminum lake",
    " monohydrate",
    " anhydrous",
    " solution",
    " syrup",
    " liquid",
]

DYE_PATTERN = (
    r"^(?:(?:fdc|dc)\s+)?(red|yellow|blue|green|orange|violet)\s+(?:dye\s+)?no\s+"
    r"([a-z0-9]+)(?:\s+aluminum\s+lake)?$"
)
UNII_CODE_PATTERN = r"^[A-Z0-9]{10}$"

# --- Fixed values: free-text query normalisation -----------------------------

QUERY_NDC_PATTERN = r"\b\d{4,5}-\d{3,4}-\d{1,2}\b|\b\d{10,11}\b"
QUERY_STRENGTH_PATTERN = (
    r"(?i)\b\d+(?:\.\d+)?\s*(?:mcg|mg|g|kg|mL|L|%)"
    r"(?:\s*/\s*\d+(?:\.\d+)?\s*(?:mcg|mg|g|kg|mL|L|%))?\b"
)
# spelling accepted after a number -> canonical spelling
UNITS = [
    ("mcg|μg|ug", "mcg"),
    ("mg", "mg"),
    ("kg", "kg"),
    ("g", "g"),
    ("ml", "mL"),
    ("l", "L"),
    ("%", "%"),
]

ROUTE_HINTS = {
    "oral": "ORAL",
    "topical": "TOPICAL",
    "nasal": "NASAL",
    "ophthalmic": "OPHTHALMIC",
    "otic": "OTIC",
    "injectable": "INJECTABLE",
    "injection": "INJECTION",
    "intravenous": "INTRAVENOUS",
    "intramuscular": "INTRAMUSCULAR",
    "subcutaneous": "SUBCUTANEOUS",
}

FORM_HINTS = {
    "tablet": "TABLET",
    "capsule": "CAPSULE",
    "solution": "SOLUTION",
    "suspension": "SUSPENSION",
    "syrup": "SYRUP",
    "cream": "CREAM",
    "ointment": "OINTMENT",
    "spray": "SPRAY",
    "gel": "GEL",
}

# --- Fixed values: concept ranking -------------------------------------------

USEFUL_TTYS = ["SCD", "SBD", "SCDG", "IN", "PIN", "MIN"]
TTY_SCORES = {
    "SCD": 40.0,
    "SBD": 38.0,
    "SCDG": 28.0,
    "PIN": 18.0,
    "MIN": 16.0,
    "IN": 14.0,
}
OTHER_TTY_SCORE = -50.0
ORAL_LIQUID_FORMS = ["SOLUTION", "SUSPENSION", "SYRUP"]
INJECTABLE_ROUTES = [
    "INJECTABLE",
    "INJECTION",
    "INTRAVENOUS",
    "INTRAMUSCULAR",
    "SUBCUTANEOUS",
]
INJECTION_MARKERS = ["inject", "intraven", "intramuscular", "subcutaneous", "iv"]
NON_ORAL_MARKERS = ["topical", "ophthalmic", "otic", "nasal", "dermal", "transdermal"]
STOPWORDS = [
    "oral",
    "tablet",
    "capsule",
    "solution",
    "suspension",
    "syrup",
    "injectable",
    "injection",
    "ophthalmic",
    "topical",
    "otic",
    "nasal",
    "mg",
    "mcg",
    "g",
    "kg",
    "ml",
    "m",
    "l",
]
ABBREVIATIONS = {
    "cap": "capsule",
    "caps": "capsule",
    "inj": "injection",
    "liq": "liquid",
    "ophth": "ophthalmic",
    "po": "oral",
    "sol": "solution",
    "soln": "solution",
    "susp": "suspension",
    "syr": "syrup",
    "tab": "tablet",
    "tabs": "tablet",
    "top": "topical",
}
SUGGESTION_LIMIT = 8
CANDIDATE_LIMIT = 16
EXPANSION_LIMIT = 100

# --- Fixed values: ingredient text clean-up ----------------------------------

INGREDIENT_UNII_PATTERN = r"(?i)\(UNII:\s*([A-Z0-9]+)\)"
INGREDIENT_STRENGTH_PATTERN = (
    r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|kg|mL|ml|L|%)"
    r"(?:\s*/\s*\d+(?:\.\d+)?\s*(?:mg|mcg|g|kg|mL|ml|L|%))?\b"
)
TRAILING_STRENGTH_PATTERN = r"(?i)\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|kg|mL|ml|L|%)\b.*$"
LEADING_LABEL_PATTERN = r"(?i)^(?:inactive ingredients?|active ingredients?|contains)\s*:\s*"
HEADER_LINES = [
    "ingredient name",
    "strength",
    "inactive ingredients",
    "inactive ingredient",
    "active ingredients",
    "active ingredient",
    "basis of strength",
    "contains",
]
INGREDIENT_HEADERS = [
    "ingredient",
    "ingredient name",
    "active ingredient",
    "active moiety",
    "inactive ingredient",
    "name",
]
STRENGTH_HEADERS = ["basis of strength", "amount"]
INACTIVE_SECTION_TERMS = ["inactive ingredient", "inactive ingredients"]
ACTIVE_SECTION_TERMS = ["active ingredient", "active ingredients", "active moiety"]
CONFIDENCE = {"table": "high", "xml_structured": "medium"}

# --- Fixed values: display names ---------------------------------------------

TRAILING_FORMULATION_PATTERN = (
    r"(?i)\b(suspension|solution|syrup|elixir|liquid|drops|emulsion|concentrate|"
    r"oral suspension|oral solution|oral drops|for suspension|for solution|"
    r"reconstituted|reconstitution|injection|injectable|infusion|"
    r"tablet|tablets|capsule|capsules|patch|cream|ointment|gel|lotion|"
    r"powder|granules|suppository|suppositories|spray|inhaler|"
    r"extended release|immediate release|delayed release|modified release|"
    r"er|xr|sr|dr|ir)\s*$"
)
SMALL_WORDS = ["and", "or", "of", "in", "with", "for", "the", "a", "an"]

# --- Fixed values: label XML codes -------------------------------------------

HL7_NAMESPACE = "urn:hl7-org:v3"
NDC_CODE_SYSTEM = "2.16.840.1.113883.6.69"
UNII_CODE_SYSTEM = "2.16.840.1.113883.4.9"
NDC_PATTERN = r"^\d{4,5}-\d{3,4}-\d{1,2}$"
ACTIVE_CLASS_CODES = ["ACTIB", "ACTIM", "ACTIR"]
APP_ACTIVE_CLASS_CODES = ["ACTIM", "ACTIB", "ACTIR", "ACTI"]
INACTIVE_CLASS_CODES = ["IACT"]
PRESCRIPTION_DOC_CODE = "34391-3"
CHANGES_SECTION = "Recent Major Changes"
SECTION_NAMES = {
    "60561-8": "Recent Major Changes",
    "34066-1": "Boxed Warning",
    "34067-9": "Indications and Usage",
    "43678-2": "Dosage Forms and Strengths",
    "34068-7": "Dosage and Administration",
    "34070-3": "Contraindications",
    "34071-1": "Warnings and Precautions",
    "34072-9": "Precautions",
    "34073-7": "Drug Interactions",
    "34074-5": "Drug / Laboratory Test Interactions",
    "43684-0": "Use in Specific Populations",
    "34076-0": "Patient Counseling Information",
    "34083-6": "Adverse Reactions",
    "34084-4": "Drug Abuse and Dependence",
    "34085-1": "Overdosage",
    "34089-3": "Description",
    "34086-9": "Clinical Pharmacology",
    "43680-8": "Pharmacodynamics",
    "43682-4": "Pharmacokinetics",
    "34088-5": "Clinical Studies",
    "34069-5": "How Supplied / Storage and Handling",
    "42230-3": "Patient Counseling Information",
    "34093-5": "Patient Information",
}
CHANGE_DATE_PATTERN = r"\b(\d{1,2})/(\d{4})\b"
CHANGES_LOOKBACK_DAYS = 60
CHANGES_CANDIDATE_LIMIT = 300
CHANGES_SHOWN_LIMIT = 100

# --- Fixed values: drug names commonly formulated as oral liquids ------------

LIQUID_DRUGS = [
    "acetaminophen", "ibuprofen", "oxycodone", "hydrocodone", "morphine",
    "codeine", "tramadol", "methadone", "buprenorphine", "naloxone",
    "amoxicillin", "ampicillin", "azithromycin", "cephalexin", "cefdinir",
    "cefprozil", "cefuroxime", "clarithromycin", "clindamycin", "erythromycin",
    "metronidazole", "nitrofurantoin", "penicillin", "sulfamethoxazole",
    "trimethoprim", "doxycycline", "levofloxacin", "linezolid",
    "fluconazole", "nystatin", "itraconazole", "valganciclovir", "acyclovir",
    "oseltamivir", "ribavirin",
    "omeprazole", "lansoprazole", "ranitidine", "famotidine", "metoclopramide",
    "ondansetron", "lactulose", "bismuth", "simethicone", "magnesium hydroxide",
    "aluminum hydroxide", "sucralfate",
    "guaifenesin", "dextromethorphan", "promethazine", "diphenhydramine",
    "hydroxyzine", "chlorpheniramine", "cetirizine", "loratadine", "fexofenadine",
    "risperidone", "haloperidol", "aripiprazole", "lithium", "sertraline",
    "fluoxetine", "fluphenazine", "thioridazine",
    "levetiracetam", "carbamazepine", "oxcarbazepine", "valproic acid",
    "phenytoin", "phenobarbital", "diazepam", "lorazepam", "clonazepam",
    "zonisamide", "lacosamide",
    "digoxin", "captopril", "enalapril", "propranolol", "metoprolol",
    "hydralazine", "furosemide", "spironolactone", "amlodipine",
    "ferrous sulfate", "potassium chloride", "zinc sulfate", "folic acid",
    "cyanocobalamin", "vitamin d", "iron",
    "prednisolone", "dexamethasone", "prednisone", "budesonide",
    "methylprednisolone", "hydrocortisone",
    "metformin", "glipizide",
    "tacrolimus", "cyclosporine", "mycophenolate",
    "megestrol", "baclofen", "loperamide", "levothyroxine", "potassium iodide",
    "caffeine", "theophylline",
]

# --- Fixed values: output column lists ---------------------------------------

TIER_CSV_COLUMNS = [
    "spl_setid", "product_name", "labeler", "dosage_form", "form_class",
    "route", "route_class", "ndcs", "active_ingredients_raw", "concern_tier",
    "inclusion_decision", "review_reason",
    "included_form_match", "excluded_form_match",
    "included_route_match", "excluded_route_match",
    "inactive_ingredients_raw", "matched_sugar_alcohols",
    "matched_sugar_alcohol_terms", "source_file", "processed_at",
]
TIER_CSV_NAMES = {
    "high": "final_products_of_concern",
    "moderate": "moderate_products_of_concern",
    "review": "review_products",
    "excluded": "excluded_products_debug",
}
BROAD_RECALL_COLUMNS = [
    "spl_setid", "product_name", "labeler", "dosage_form", "route",
    "form_class", "route_class", "matched_sugar_alcohols",
    "matched_sugar_alcohol_terms", "concern_tier", "in_strict_output",
    "source_file",
]
INDEX_CSV_COLUMNS = [
    "product_name", "setid", "labeler", "dosage_form", "route",
    "active_ingredient", "strength", "ndcs",
    "form_class", "route_class",
    "included_form_match", "excluded_form_match",
    "included_route_match", "excluded_route_match",
    "matched_sugar_alcohols", "matched_sugar_alcohol_terms",
    "concern_tier", "review_reason",
]
INDEX_CSV_NAMES = {
    "high": "high_concern",
    "moderate": "moderate_concern",
    "review": "review",
    "excluded": "excluded_debug",
}
SAMPLE_COLUMNS = [
    "spl_setid", "product_name", "labeler", "dosage_form", "form_class",
    "route", "route_class", "concern_tier", "inclusion_decision",
    "review_reason", "matched_sugar_alcohols", "matched_sugar_alcohol_terms",
    "inactive_ingredients_raw", "source_file", "processed_at",
]
FUNNEL_STAGES = [
    "total_xml_files", "parse_successes", "parse_failures",
    "total_records", "non_human_skipped",
    "with_dosage_form", "strong_liquid_form", "ambiguous_form",
    "excluded_form", "non_liquid_form",
    "with_route", "allowed_route", "excluded_route", "blank_route",
    "with_inactive_ingredients", "with_sugar_alcohol_hit",
    "final_high", "final_moderate", "final_review", "final_excluded",
]
SAMPLE_SIZE = 25
SNAPSHOT_TTL_HOURS = 24
