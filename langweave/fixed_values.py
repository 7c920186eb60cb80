"""Fixed values that results must carry exactly: labels, source tags, prompts, patterns, messages."""

from __future__ import annotations

# --- Fixed values: class labels, in index order, with display names -------------------------
LABELS = ("AR_DAR", "AR_MSA", "EN", "FR")
LABEL_NAMES = {
    "AR_DAR": "Darija",
    "AR_MSA": "Arabe MSA",
    "EN": "Anglais",
    "FR": "Français",
}
RTL_LABELS = ("AR_DAR", "AR_MSA")

# --- Fixed values: source tags and id prefixes ----------------------------------------------
DIALECT_SOURCE, DIALECT_PREFIX, DIALECT_LABEL = "Atlaset", "atlaset", "AR_DAR"
LANGID_SOURCE, LANGID_PREFIX = "papluca", "fren"
MSA_SOURCE, MSA_PREFIX = "NADI2022", "nadi"
LANGID_CODES = ("fr", "en")

# --- Fixed values: job settings -------------------------------------------------------------
SEED = 42
SPLIT_RATIOS = {"train": 0.70, "valid": 0.15, "test": 0.15}
MAX_FEATURES = 10_000
WORD_NGRAMS = (1, 3)
CHAR_NGRAMS = (2, 4)
SILVER_CONFIDENCE = 0.60
CS_RATIO_THRESHOLD = 0.30
LANGID_MIN_TOKENS = 3
MIX_MIN_TOKENS = 2
MIX_LABEL = "MIX"
GOLD_SAMPLES = 500
SVM_C = 1.0
SVM_MAX_ITER = 2000

# --- Fixed values: arabizi digits and the Arabic letters they stand for ----------------------
ARABIZI_DIGITS = {
    "7": "ح",
    "3": "ع",
    "9": "ق",
    "2": "ء",
    "5": "خ",
    "6": "ط",
    "8": "غ",
}

# --- Fixed values: detector and generator names, request settings ----------------------------
DETECTOR_NAME = "XLM-RoBERTa (fine-tuned)"
GENERATOR_NAME = "Qwen3.5-397B-A17B"
GENERATOR_MODEL = "Qwen/Qwen3.5-397B-A17B"
TEMPERATURE = 0.4
MAX_TOKENS = 512
FAILED_STATUS = 500
FAILED_MESSAGE = "Erreur serveur"
REJECT_STATUS = 400
REJECT_MESSAGE = "Le champ 'text' est requis."

# --- Fixed values: system prompt per prompt key ----------------------------------------------
SYSTEM_PROMPTS = {
    "EN": (
        "You are a helpful assistant. "
        "You MUST respond ONLY in English. "
        "Keep your answers clear, concise, and natural."
    ),
    "FR": (
        "Tu es un assistant utile. "
        "Tu DOIS répondre UNIQUEMENT en français. "
        "Tes réponses doivent être claires, concises et naturelles."
    ),
    "AR_MSA": (
        "أنت مساعد ذكي ومفيد. "
        "يجب أن تجيب فقط باللغة العربية الفصحى. "
        "لا تستخدم أي لهجة عامية. "
        "اجعل إجاباتك واضحة وموجزة."
    ),
    "AR_DAR_AR": (
        "نتا مساعد ذكي. "
        "خاصك تجاوب غير بالدارجة المغربية بالحروف العربية. "
        "ما تستعملش الفصحى، تكلم بالدارجة كيما كيهضرو المغاربة فالحياة اليومية. "
        "خلي الأجوبة ديالك بسيطة وطبيعية."
    ),
    "AR_DAR_LAT": (
        "Nta mo3awin zwine. "
        "Khassek tjaweb ghi b darija maghribiya b l7orouf latinia (arabizi). "
        "Ma tktebch b l3arabiya wla b français wla anglais. "
        "Kteb kima kayktbo lmgharba f WhatsApp wla Facebook. "
        "Khelli ljawab bsit w tabi3i."
    ),
}

# --- Fixed values: robustness phrases with their expected label -------------------------------
ROBUSTNESS_PHRASES = (
    ("واش نتا لاباس عليك؟", "AR_DAR"),
    ("wach nta labas 3lik?", "AR_DAR"),
    ("ما هي أهم التطورات في الذكاء الاصطناعي؟", "AR_MSA"),
    ("Quels sont les avantages du machine learning?", "FR"),
    ("What are the best NLP practices?", "EN"),
    ("كنبغي نمشي للسوق باش نشري الخضرة", "AR_DAR"),
    ("bghit nmchi l souk bach nchri lkhodra", "AR_DAR"),
    ("يجب علينا تطوير البنية التحتية الرقمية", "AR_MSA"),
    ("L'intelligence artificielle transforme notre quotidien", "FR"),
    ("Deep learning has revolutionized computer vision", "EN"),
)
