"""Fixed values of the payment vocabulary and of the models' settings. The order of families and classes
is the order of their numbers and of ties."""

from __future__ import annotations

# --- fixed values: families, classes and their names -------------------------------------------------
FAMILIES = ("cloud", "gym", "insurance", "mobile", "music", "software", "streaming")
NONE = "none"
CLASSES = (*FAMILIES, NONE)
FAMILY_NAMES = {
    "cloud": ("cloud access", "cloud backup", "service plan", "storage plan"),
    "gym": ("urban gym", "fitness monthly", "fit club", "gym membership"),
    "insurance": ("cover plan", "policy premium", "safe cover", "insurance monthly", "cover monthly"),
    "mobile": ("phone contract", "service bill", "monthly plan", "digital plus"),
    "music": ("member pass", "audio streaming", "digital plus", "premium plan"),
    "software": ("saas billing", "software access", "productivity suite", "premium plan"),
    "streaming": ("media streaming", "video access", "digital plus", "premium plan"),
}
FAMILY_MCC = {"cloud": "5732", "gym": "7997", "insurance": "6300", "mobile": "4814", "music": "5812", "software": "5734", "streaming": "5812"}
GENERIC_SUBSCRIPTION = ("subscription charge", "monthly plan", "member plan", "digital service")
UNAMBIGUOUS_GENERIC = ("subscription charge", "member plan", "digital service")
GENERIC_EVERYDAY = ("digital order", "service payment", "card purchase", "merchant charge")
EVERYDAY_MCC = {
    "ride share": "4111",
    "fresh foods": "5411",
    "neighborhood market": "5411",
    "grocery store": "5411",
    "electronics shop": "5732",
    "online marketplace": "5732",
    "coffee shop": "5812",
    "casual dining": "5812",
    "pharmacy": "5912",
    "hotel booking": "7011",
}
EVERYDAY = tuple(EVERYDAY_MCC)
OTHER = ("atm withdrawal", "salary", "p2p send", "p2p receive", "service fee")
ABBREVIATIONS = {"dgtl": "digital", "prem": "premium", "mth": "monthly", "prod": "productivity", "stream": "streaming"}
PREFIXES = ("billing", "member", "pay")
SUFFIXES = ("core", "dgtl", "digital", "online", "plus", "service")
CARD_MCCS = ("4111", "4814", "5411", "5732", "5734", "5812", "5912", "6300", "7011", "7997")
KINDS = ("other", "everyday", "generic_eve", "generic_sub", "fam")  # by rising priority
SUBSCRIPTION_KINDS = ("fam", "generic_sub", "unknown")
TYPES = ("card_payment", "topup", "p2p_transfer", "transfer", "atm", "refund", "fee")
CURRENCIES = ("chf", "eur", "usd", "gbp")

# --- fixed values: keyword stack ----------------------------------------------------------------------
KEYWORDS = {
    "cloud": ("cloud", "backup", "storage", "service plan"),
    "gym": ("gym", "fit", "fitness", "club", "urban"),
    "insurance": ("cover", "insurance", "policy", "safe"),
    "mobile": ("phone", "contract", "service bill", "bill"),
    "music": ("audio", "member pass", "pass"),
    "software": ("saas", "productivity", "suite", "software", "prod"),
    "streaming": ("media", "video", "stream", "streaming"),
}
KEYWORD_MCC = {4814: "mobile", 5732: "cloud", 5734: "software", 6300: "insurance", 7997: "gym"}
NON_RECURRING = EVERYDAY + OTHER
CLEAN = tuple(sorted({n for names in FAMILY_NAMES.values() for n in names} - {"cover monthly"} | set(GENERIC_SUBSCRIPTION)))

# --- fixed values: listwise stack ---------------------------------------------------------------------
PATTERNS = {
    "cloud": r"cloud|backup|storage",
    "gym": r"gym|fitness|\bfit\b|urban|club|membership",
    "insurance": r"insurance|policy|cover|safe",
    "mobile": r"phone|contract|service bill",
    "music": r"audio|member pass|\bpass\b",
    "software": r"software|saas|productivity|\bprod\b|suite",
    "streaming": r"video|media",
}
BACKGROUND = r"salary|atm|fresh foods|pharmacy|hotel|booking|electronics|ride|coffee|grocery|neighborhood|marketplace|casual|dining|p2p|service fee"
CADENCES = (7.0, 14.0, 30.0, 30.4375, 60.0, 60.875, 90.0, 91.3125, 180.0, 365.0)
PHASES = (7, 14, 30, 60, 90, 365)
JOINT = (
    "n", "age", "amount_cv", "gap_med", "core_n", "core_age", "core_amount_cv", "core_cadence_due", "core_cadence_error",
    "cadence_due", "cadence_error", "core_active_due_1.5", "refund_n",
)

# --- fixed values: likelihoods, noise levels, seeds ---------------------------------------------------
TOLERANCE = 0.035
EPSILON_DESCRIPTION, EPSILON_REFUND, MCC_NOISE = 0.10, 0.05, 0.30
PRIOR_LOW, PRIOR_HIGH, PRIOR_BINS = 1.5, 800.0, 40
TEST_LEVEL = {"mask": 0.54, "mcc": 0.22, "affix": 0.65, "eve_mask": 0.67, "eve_mcc": 0.12}
VALID_LEVEL = {"mask": 0.37, "mcc": 0.16, "affix": 0.59, "eve_mask": 0.47, "eve_mcc": 0.09}
VALID_TO_TEST = {"eve_mask": 0.38, "eve_mcc": 0.04, "mask": 0.25, "mcc": 0.10, "affix": 0.08}
FOLDS = 5
BOOTSTRAP_SAMPLES, BOOTSTRAP_SEED = 2000, 1729

# --- derived by rule ----------------------------------------------------------------------------------
BASES = tuple(sorted({n for names in FAMILY_NAMES.values() for n in names} | {*GENERIC_SUBSCRIPTION, *GENERIC_EVERYDAY, *EVERYDAY, *OTHER}))
BASE_FAMILIES = {b: tuple(f for f in FAMILIES if b in FAMILY_NAMES[f]) for b in BASES}
KIND_MEMBERS = {
    "fam": tuple(b for b in BASES if BASE_FAMILIES[b]),
    "generic_sub": GENERIC_SUBSCRIPTION,
    "generic_eve": GENERIC_EVERYDAY,
    "everyday": EVERYDAY,
    "other": OTHER,
}
TRUNCATIONS: dict[str, tuple[str, ...]] = {}
for _base in BASES:
    _tokens = _base.split()
    if len(_tokens) > 1:
        for _token in {_tokens[0], _tokens[-1]}:
            TRUNCATIONS[_token] = tuple(sorted({*TRUNCATIONS.get(_token, ()), _base}))
