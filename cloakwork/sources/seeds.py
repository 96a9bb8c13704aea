"""What a fresh installation knows: patterns, types, policies, contexts, word lists and rules.

Everything here is a fixed value: the detection results and the tables depend on each of them.
"""

from __future__ import annotations

# Fixed values: (type, pattern, flags, capture group) in Python's dialect. Every group ends where its match ends.
ACCENTED, ACCENTED_CAPITALS = "àáèéìíòóùú", "ÀÁÈÉÌÍÒÓÙÚ"
CAPITALISED = rf"[A-Z{ACCENTED_CAPITALS}][a-z{ACCENTED}]+"
CONTRACT_ID = r"([A-Z0-9]{2,}-[\w\-]{2,}|[A-Z]{2,}\d{3,}[\w\-]*|\d{5,})\b"
PATTERNS = [
    ("ACCOUNT", r"@([A-Za-z0-9_]{3,50})\b", "", 1),
    ("API_KEY", r"\b(?:sk|pk|rk|ghp|gho|ghu|ghs|ghr)-[A-Za-z0-9_\-]{20,}\b", "", 0),
    ("BIC", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", "", 0),
    ("CITY_BORN", rf"(?i:nat[ao])\s+a\s+({CAPITALISED}(?:\s+{CAPITALISED}){{0,3}})", "", 1),
    (
        "COMPANY",
        r"\b([A-Z][A-Za-z0-9&']{0,30}(?:\s+(?:&|e|di|del|della|dei|[A-Z][A-Za-z0-9&']{0,25})){0,4}"
        r"\s+(?:S\.r\.l\.s\.|S\.r\.l\.|S\.p\.A\.|S\.n\.c\.|S\.a\.s\.|S\.c\.r\.l\.|SpA|Srl|Snc|Sas|SRL|SPA|SNC|SAS)\.?)",
        "",
        1,
    ),
    ("CVV", r"(?:cvv|cvc|codice\s+di\s+verifica)[^\d]{0,10}(\d{3,4})", "IGNORECASE", 1),
    ("DATE", r"\b(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{4})\b", "", 1),
    (
        "DATE",
        r"\b(\d{1,2}\s+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s+\d{4})\b",
        "IGNORECASE",
        1,
    ),
    ("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "", 0),
    ("FISCAL_CODE", r"\b[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]\b", "", 0),
    ("GPS_COORDINATE", r"-?\d{1,3}\.\d{4,},\s*-?\d{1,3}\.\d{4,}", "", 0),
    ("IBAN", r"\bIT\d{2}[A-Z0-9]{23}\b", "", 0),
    ("IDENTITY_CARD", r"(?i:carta\s+d.identit[àa]|C\.?I\.?)\s*[:\s]\s*([A-Z]{2}\d{7})\b", "IGNORECASE", 1),
    ("IMEI", r"(?i)\bIMEI\s*:?\s*(\d{15,17})\b", "IGNORECASE", 1),
    ("LOYALTY_ID", r"(?i:frequent\s+flyer|loyalty|mileage|carta\s+fedelt[àa])\b[\s\w]{0,20}?([A-Z]{2}\d{6,12}|[A-Z0-9]{7,15})\b", "IGNORECASE", 1),
    ("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b", "", 0),
    ("PASSPORT", r"\b[A-Z]{2}\d{7}\b", "", 0),
    ("PHONE", r"(?<!\d)(?:\+39\s*|0039\s*)?(?:0\d[\s./\-]?\d{7,8}|0\d{2,3}[\s./\-]?\d{6}|3\d{2}[\s.\-]?\d{6,7})(?!\d)", "", 0),
    ("PIN", r"(?:pin|codice\s+pin|codice\s+segreto)[^\d]{0,10}(\d{4,6})", "IGNORECASE", 1),
    ("PIVA", r"(?:p\.?\s?iva|partita\s+iva)[^\d]*(\d{11})", "IGNORECASE", 1),
    ("PNR", r"\bPNR\s+([A-Z0-9]{5,8})\b", "", 1),
    ("POLICY_NUMBER", r"(?i:contratto\s+assicurativo|polizza)\s+(?:[\w]+\s+){0,2}(?:n\.?\s*|numero\s*)?" + CONTRACT_ID, "IGNORECASE", 1),
    ("POLICY_NUMBER", r"(?i:sinistro|pratica|caso)\b.{0,40}?\bcodice\s+" + CONTRACT_ID, "IGNORECASE|DOTALL", 1),
    ("PRACTICE_ID", r"(?i)(?:pratica\s+(?:sanitaria|medica)|numero\s+pratica)[\s\w.,#°]{0,20}?([A-Z]{2,5}-[\w\-]{4,}|\d{5,})", "IGNORECASE", 1),
    ("SALARY", r"(?i)\bral\b[^\d]{0,25}(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?)", "IGNORECASE", 1),
    ("TARGA", r"\b[A-Z]{2}\s?\d{3}\s?[A-Z]{2}\b", "", 0),
    ("USERNAME", r"(?:username|login)\s*:\s*(\S{3,})", "IGNORECASE", 1),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "", 0),
]

# Patterns a user of the bundled tables would add; the last one's group isn't the end of its match.
USER_PATTERNS = [
    ("CREDIT_CARD", r"\b[0-9]{16}\b", "", 0),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "", 0),
    ("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "", 0),
    ("SECRET", r"token = \"([0-9a-f]{40})\"", "", 1),
]

# Code, category, display name, default action, surrogate strategy, reversible.
PII_TYPES = [
    ("PERSON", "IDENTITY", "Persona", "protect", "person", True),
    ("FISCAL_CODE", "IDENTITY", "Codice Fiscale", "protect", "fiscal_code", True),
    ("PASSPORT", "IDENTITY", "Passaporto", "protect", "passport", True),
    ("IDENTITY_CARD", "IDENTITY", "Carta d'Identità", "protect", "identity_card", True),
    ("DRIVER_LICENSE", "IDENTITY", "Patente", "protect", "driver_license", True),
    ("HEALTH_CARD", "IDENTITY", "Tessera Sanitaria", "protect", "health_card", True),
    ("EMAIL", "CONTACT", "Email", "protect", "email", True),
    ("PHONE", "CONTACT", "Telefono", "protect", "phone", True),
    ("ADDRESS", "CONTACT", "Indirizzo", "protect", "address", True),
    ("CITY_BORN", "CONTACT", "Città di Nascita", "protect", "city", True),
    ("ACCOUNT", "CONTACT", "Account / Handle", "protect", "username", True),
    ("IBAN", "FINANCIAL", "IBAN", "protect", "iban", True),
    ("CREDIT_CARD", "FINANCIAL", "Carta di Credito", "protect", "credit_card", True),
    ("SALARY", "FINANCIAL", "RAL / Stipendio", "protect", "salary", True),
    ("MONEY", "FINANCIAL", "Importo", "keep", None, False),
    ("DATE", "LEGAL", "Data", "keep", "date_shift", False),
    ("LAW_REF", "LEGAL", "Riferimento Normativo", "keep", None, False),
    ("PRACTICE_ID", "LEGAL", "Numero Pratica", "protect", "practice_id", True),
    ("POLICY_NUMBER", "LEGAL", "Numero Polizza", "protect", "policy_number", True),
    ("LOYALTY_ID", "LEGAL", "Codice Fedeltà", "protect", "loyalty_id", True),
    ("PNR", "LEGAL", "PNR", "protect", "pnr", True),
    ("TICKET_ID", "LEGAL", "Ticket ID", "protect", "ticket_id", True),
    ("TARGA", "VEHICLE", "Targa", "protect", "targa", True),
    ("IMEI", "VEHICLE", "IMEI", "protect", "imei", True),
    ("IP_ADDRESS", "NETWORK", "Indirizzo IP", "protect", "ip", True),
    ("MAC_ADDRESS", "NETWORK", "MAC Address", "protect", "mac", True),
    ("URL", "NETWORK", "URL", "protect", "url", True),
    ("GPS_COORDINATE", "NETWORK", "Coordinate GPS", "protect", "gps", True),
    ("API_KEY", "NETWORK", "API Key", "protect", "api_key", True),
    ("SECRET", "CREDENTIAL", "Password / Segreto", "protect", "password", False),
    ("USERNAME", "CREDENTIAL", "Username", "protect", "username", True),
    ("BIC", "FINANCIAL", "BIC / SWIFT", "protect", "bic", True),
    ("ORGANIZATION", "IDENTITY", "Organizzazione", "protect", "organization", True),
    ("COMPANY", "IDENTITY", "Azienda", "protect", "company", True),
    ("DATE_BORN", "IDENTITY", "Data di Nascita", "protect", "date_shift", True),
]

# The types each domain protects and keeps.
POLICIES = {
    "default": (
        "PERSON FISCAL_CODE PASSPORT IDENTITY_CARD DRIVER_LICENSE HEALTH_CARD EMAIL PHONE ADDRESS ACCOUNT IBAN CREDIT_CARD SALARY PRACTICE_ID "
        "POLICY_NUMBER LOYALTY_ID PNR TICKET_ID TARGA IMEI IP_ADDRESS MAC_ADDRESS API_KEY SECRET USERNAME BIC ORGANIZATION COMPANY CITY_BORN",
        "DATE MONEY LAW_REF URL GPS_COORDINATE",
    ),
    "fine_appeal": ("PERSON FISCAL_CODE EMAIL PHONE ADDRESS IBAN IDENTITY_CARD DRIVER_LICENSE ACCOUNT CITY_BORN", "DATE MONEY LAW_REF TARGA PRACTICE_ID TICKET_ID"),
    "contract_analysis": (
        "PERSON FISCAL_CODE EMAIL PHONE ADDRESS IBAN CREDIT_CARD TARGA IDENTITY_CARD ACCOUNT CITY_BORN COMPANY ORGANIZATION",
        "DATE MONEY LAW_REF POLICY_NUMBER",
    ),
    "medical": ("PERSON FISCAL_CODE EMAIL PHONE ADDRESS HEALTH_CARD ACCOUNT CITY_BORN", "DATE MONEY LAW_REF PRACTICE_ID"),
    "condominio": (
        "PERSON FISCAL_CODE PASSPORT IDENTITY_CARD DRIVER_LICENSE HEALTH_CARD EMAIL PHONE ADDRESS ACCOUNT IBAN CREDIT_CARD TARGA BIC USERNAME CITY_BORN",
        "DATE MONEY LAW_REF URL",
    ),
}

# The domain of each context type; those in SURROGATE_CONTEXTS default to surrogates, all others to tags.
CONTEXTS = {
    "default": "default",
    "hr": "default",
    "embedding": "default",
    "messaging.chat_case_qa": "default",
    "messaging.chat_answer_decision": "default",
    "messaging.intent_classify": "default",
    "messaging.dispute_safety_gateway": "default",
    "intake.conversation": "default",
    "intake.journey_classification": "default",
    "intake.legal_value_extraction": "default",
    "intake.laj": "default",
    "ai.role.critic": "default",
    "ai.role.adjudicator": "default",
    "casefacts.fact_extraction": "default",
    "casefacts.fact_extraction.incidenti": "default",
    "casefacts.fact_extraction.consumatori": "default",
    "casefacts.fact_extraction.lavoro": "default",
    "casefacts.fact_extraction.successioni": "default",
    "casefacts.fact_extraction.privacy": "default",
    "case_file_document": "default",
    "fine_appeal": "fine_appeal",
    "self_service.fine_appeal_extraction": "fine_appeal",
    "self_service.fine_appeal_drafting": "fine_appeal",
    "self_service.fine_appeal_strategy_analysis": "fine_appeal",
    "casefacts.fact_extraction.codice_della_strada": "fine_appeal",
    "messaging.document_analysis_artifact.codice_della_strada": "fine_appeal",
    "self_service.condo_dispute_drafting": "condominio",
    "casefacts.fact_extraction.condominio": "condominio",
    "messaging.document_analysis_artifact.condominio": "condominio",
    "contract_analysis": "contract_analysis",
    "legal_brief": "contract_analysis",
    "messaging.document_analysis_artifact": "contract_analysis",
    "messaging.document_analysis_artifact.contratti": "contract_analysis",
    "casefacts.fact_extraction.contratti": "contract_analysis",
    "medical": "medical",
}
SURROGATE_CONTEXTS = ("embedding", "case_file_document")

# Words that are no person on their own, and phrases no person contains.
DENIED_WORDS = (
    "coniuge padre madre fratello sorella figlio figlia nonno nonna nipote zio zia marito moglie "
    "telefono cellulare fax email pec indirizzo nome cognome "
    "data luogo comune stato paese via piazza corso viale numero codice tipo categoria nota note sede ufficio azienda studio "
    "signore signora sig gentile spett latitudine longitudine coordinate "
    "macintosh windows intel android "
    "roma milano napoli torino palermo genova bologna firenze bari catania venezia verona messina padova trieste brescia taranto prato modena "
    "cagliari foggia reggio perugia livorno ravenna rimini salerno ferrara sassari latina monza bergamo trento vicenza terni novara bolzano "
    "piacenza ancona arezzo udine cesena lecce pescara alessandria como brindisi siracusa agrigento pesaro mestre siena"
).split()
DENIED_PHRASES = ["s.r.l", "s.p.a", "s.n.c", "s.a.s", "s.c.r.l", " spa", " srl", " snc", "comune di", "provincia di", "regione "]

# Words before a span that raise a model's score.
CONTEXT_WORDS = {
    "PERSON": (
        "coniuge padre madre marito moglie figlio figlia fratello sorella nonno nonna paziente cliente committente ricorrente "
        "convenuto difensore nome cognome intestatario"
    ).split(),
    "PHONE": "telefono cellulare tel cell fax".split(),
    "EMAIL": "email pec e-mail".split(),
}

# From, to, pattern before the span, pattern in the span, characters looked at before the span.
RULES = [
    ("PERSON", "ACCOUNT", r"(?i)(?:username|login)\s*:\s*$", None, 60),
    ("PERSON", "ORGANIZATION", r"(?i)(?:scuola|istituto|liceo|plesso|istituzione|college|università|accademia)\s+(?:\w+\s+){0,3}$", None, 80),
    ("PERSON", "ACCOUNT", None, r"@", 60),
    ("PERSON", "ACCOUNT", r"(?i)(?:telegram|instagram|twitter|facebook|linkedin|tiktok|social|handle|tag)\s*[:/]?\s*$", None, 80),
    ("PERSON", "EMAIL", r"(?i)(?:e[-\s]?mail|posta\s+elettronica|indirizzo\s+mail)\s*:?\s*$", None, 60),
    ("PERSON", "ORGANIZATION", r"(?i)(?:datore\s+di\s+lavoro|azienda|società|impresa|studio\s+professionale)\s*:?\s*$", None, 80),
    ("PERSON", "ORGANIZATION", None, r"(?i)\b(?:s\.?r\.?l\.?|s\.?p\.?a\.?|s\.?n\.?c\.?|s\.?a\.?s\.?)\b", 60),
    ("DATE", "DATE_BORN", rf"nat[ao]\s+a\s+{CAPITALISED}(?:\s+{CAPITALISED})*\s+il\s*$", None, 80),
]

# What the labels of the three model layers mean here; None is noise.
ANALYZER_LABELS = {
    "PERSON": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "DATE_TIME": "DATE", "IBAN_CODE": "IBAN", "IT_FISCAL_CODE": "FISCAL_CODE",
    "IT_DRIVER_LICENSE": "DRIVER_LICENSE", "IT_IDENTITY_CARD": "IDENTITY_CARD", "IT_PASSPORT": "PASSPORT", "CREDIT_CARD": "CREDIT_CARD", "NRP": "NRP", "URL": "URL",
}
FILTER_LABELS = {
    "private_person": "PERSON", "private_email": "EMAIL", "private_phone": "PHONE", "private_address": "ADDRESS", "private_date": "DATE", "private_url": "URL",
    "account_number": "ACCOUNT_NUMBER", "secret": "SECRET",
}
CLASSIFIER_LABELS = {
    "FIRSTNAME": "PERSON", "LASTNAME": "PERSON", "MIDDLENAME": "PERSON", "PREFIX": "PERSON", "EMAIL": "EMAIL", "PHONENUMBER": "PHONE",
    "PHONEIMEI": "PHONE", "PASSWORD": "PASSWORD", "USERNAME": "USERNAME", "ACCOUNTNUMBER": "ACCOUNT_NUMBER", "ACCOUNTNAME": "ACCOUNT_NUMBER",
    "CREDITCARDNUMBER": "CREDIT_CARD", "CREDITCARDCVV": "CVV", "MASKEDNUMBER": "MASKED_NUMBER", "SSN": "SSN", "PIN": "PIN", "IBAN": "IBAN",
    "BIC": "BIC", "BITCOINADDRESS": "CRYPTO_ADDRESS", "ETHEREUMADDRESS": "CRYPTO_ADDRESS", "LITECOINADDRESS": "CRYPTO_ADDRESS", "IPV4": "IP_ADDRESS",
    "IPV6": "IP_ADDRESS", "IP": "IP_ADDRESS", "MAC": "MAC_ADDRESS", "URL": "URL", "USERAGENT": "SECRET", "VEHICLEVRM": "TARGA",
    "VEHICLEVIN": "VEHICLE_ID", "STREET": "ADDRESS", "BUILDINGNUMBER": "ADDRESS", "SECONDARYADDRESS": "ADDRESS", "CITY": "ADDRESS",
    "STATE": "ADDRESS", "COUNTY": "ADDRESS", "ZIPCODE": "ADDRESS", "NEARBYGPSCOORDINATE": "GPS_COORDINATE", "DATE": "DATE", "DOB": "DATE",
    "TIME": None, "AGE": None, "GENDER": None, "SEX": None, "HEIGHT": None, "EYECOLOR": None, "JOBTITLE": None, "JOBAREA": None, "JOBTYPE": None,
    "COMPANYNAME": None, "ORDINALDIRECTION": None, "CURRENCY": None, "CURRENCYCODE": None, "CURRENCYNAME": None, "CURRENCYSYMBOL": None,
    "CREDITCARDISSUER": None, "AMOUNT": None,
}

# Language to locale, company forms by locale.
LOCALES = {
    "it": "it_IT", "en": "en_US", "en_gb": "en_GB", "de": "de_DE", "fr": "fr_FR", "es": "es_ES", "pt": "pt_PT", "nl": "nl_NL", "pl": "pl_PL", "cs": "cs_CZ",
    "ro": "ro_RO", "hu": "hu_HU",
}
COMPANY_FORMS = {
    "it_IT": ["S.r.l.", "S.p.A.", "S.n.c.", "S.a.s.", "S.r.l.s."],
    "en_US": ["LLC", "Inc.", "Corp.", "Ltd.", "LLP"],
    "en_GB": ["Ltd", "PLC", "LLP", "CIC"],
    "de_DE": ["GmbH", "AG", "KG", "OHG", "GmbH & Co. KG"],
    "fr_FR": ["SARL", "SA", "SAS", "SASU", "EURL"],
    "es_ES": ["S.L.", "S.A.", "S.L.U.", "S.A.U."],
    "pt_PT": ["Lda.", "S.A.", "Unipessoal Lda."],
    "nl_NL": ["B.V.", "N.V.", "V.O.F.", "C.V."],
    "pl_PL": ["Sp. z o.o.", "S.A.", "S.K.", "S.J."],
}

# Fixed values of the Italian tax code: months, cities, and the values of characters at odd places.
MONTHS = "ABCDEHLMPRST"
ODD_VALUES = dict(zip("0123456789", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21))) | dict(
    zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23))
)
CITY_CODES = {
    "Roma": "H501", "Milano": "F205", "Napoli": "F839", "Torino": "L219", "Palermo": "G273", "Genova": "D969", "Bologna": "A944", "Firenze": "D612",
    "Bari": "A662", "Catania": "C351", "Venezia": "L736", "Verona": "L781", "Messina": "F158", "Padova": "G224", "Trieste": "L424", "Brescia": "B157",
    "Prato": "G999", "Modena": "F257", "Perugia": "G478", "Livorno": "E625", "Ravenna": "H199", "Cagliari": "B354", "Foggia": "D643", "Rimini": "H294",
    "Salerno": "H703", "Ferrara": "D548", "Sassari": "I452", "Trento": "L378", "Bergamo": "A794", "Pescara": "G482", "Vicenza": "L840", "Novara": "F952",
    "Ancona": "A271", "Arezzo": "A390", "Udine": "L483", "Lecce": "E506", "Taranto": "L049", "Siracusa": "I754", "Reggio Calabria": "H224",
    "Reggio Emilia": "H223", "Monza": "F704", "Piacenza": "G535",
}
