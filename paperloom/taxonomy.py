"""Label sets, word lists, thresholds and search terms."""

from __future__ import annotations

# Extraction-method categories.
METHOD_LABELS = [
    "Large Language Models (LLMs)",
    "Traditional Deep Learning",
    "Transformer-based (Non-LLM)",
    "Classical Machine Learning",
    "Rule-Based & Hybrid",
    "Knowledge Graph & Ontology",
    "Multi-Modal",
    "Other/Unspecified",
]
METHOD_FALLBACK = "Other/Unspecified"

# Named models and method words that point to a method category.
METHOD_WORDS = {
    "Large Language Models (LLMs)": [
        "GPT-3", "GPT-4", "ChatGPT", "GPT-3.5",
        "BERT", "SciBERT", "MatBERT", "MaterialsBERT", "BioBERT", "ChemBERT",
        "T5", "SciFive", "MaterialsT5",
        "LLaMA", "LLaMA-2", "Alpaca",
        "PaLM", "Claude", "Gemini", "Mistral", "Qwen", "Baichuan",
    ],
    "Traditional Deep Learning": [
        "LSTM", "BiLSTM", "GRU", "CNN", "convolutional neural network", "RNN", "recurrent neural network",
    ],
    "Transformer-based (Non-LLM)": ["transformer", "seq2seq"],
    "Classical Machine Learning": [
        "CRF", "conditional random field", "SVM", "support vector machine", "random forest",
        "decision tree", "naive bayes", "maximum entropy",
    ],
    "Rule-Based & Hybrid": [
        "regular expression", "pattern matching", "dictionary", "lexicon", "rule-based", "ChemDataExtractor", "hybrid",
    ],
    "Knowledge Graph & Ontology": ["knowledge graph", "ontolog", "graph neural network", "GNN", "knowledge base"],
    "Multi-Modal": ["vision-language", "multi-modal"],
}

# Secondary tags.
METHOD_TAGS = ["fine-tuned", "pre-trained", "domain-specific", "end-to-end", "pipeline", "zero-shot", "ensemble"]

# Material categories.
MATERIAL_LABELS = [
    "Nanoparticles",
    "Battery Cathode Materials",
    "Photocatalytic Materials",
    "Polymers",
    "Thermoelectric Materials",
    "MOFs (Metal-Organic Frameworks)",
    "Biomaterials",
    "2D Materials",
    "Semiconductor Materials",
    "Other Materials",
]
MATERIAL_FALLBACK = "Other Materials"

# Indicator words of the material categories.
MATERIAL_WORDS = {
    "Nanoparticles": ["nanoparticles", "NPs", "quantum dots", "QDs", "nanospheres"],
    "Battery Cathode Materials": ["cathode", "positive electrode", "NCM", "LFP", "LCO"],
    "Photocatalytic Materials": ["photocatalyst", "photocatalytic", "water splitting", "photodegradation"],
    "Polymers": ["polymer", "polyethylene", "PMMA", "resin"],
    "Thermoelectric Materials": ["thermoelectric", "Seebeck", "ZT", "Bi2Te3", "PbTe"],
    "MOFs (Metal-Organic Frameworks)": ["MOF", "metal-organic framework", "ZIF", "UiO", "COF"],
    "Biomaterials": [
        "biomaterial", "biocompatible", "tissue engineering", "drug delivery", "hydroxyapatite", "scaffold",
    ],
    "2D Materials": ["graphene", "MoS2", "MXene", "2D material", "monolayer", "few-layer"],
    "Semiconductor Materials": ["semiconductor", "Si wafer", "GaN", "GaAs", "p-type", "n-type", "bandgap"],
}

# Confidence levels, strongest first.
CONFIDENCE_LEVELS = ["high", "medium", "low"]

# Texts that a CSV reader of the pandas family takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Topic search. A paper must match every group of TOPIC_ALL_OF and none of TOPIC_NONE_OF.
# A trailing star stands for any word ending.
TOPIC_ALL_OF = [
    [
        "materials science", "material*", "materials informati*", "materials data", "materials database",
        "Material Properties", "Experimental Materials Data",
    ],
    ["information", "literature", "data*", "text", "document", "knowledge", "paper", "Ontolog*"],
    ["mining", "extract*", "collect*", "Autogenerat*"],
    [
        "NLP", "natural language processing", "named entity recognition", "NER", "machine learning",
        "deep learning", "large language model*", "BERT model*", "semantic*", "artificial intelligence",
    ],
]
TOPIC_NONE_OF = [["COURSES", "MEDICINE"]]
TOPIC_EXCLUDED_CATEGORIES = ["Health Care Sciences & Services"]

# Thresholds.
YEAR_MIN, YEAR_MAX = 2000, 2026
YEAR_IF_ABSENT = 2020.0
RECENT_YEARS = 5
MIN_SUPPORT = 3
SMALL_SHARE = 0.03
LABEL_SHARE = 0.04
TREND_POINTS = 300
TOP_MODELS_REPORT, TOP_SUMMARY, TOP_MATERIALS, TOP_JOURNALS = 20, 10, 12, 15
CROSSTAB_METHODS, CROSSTAB_MATERIALS = 8, 10

# Column names of the bibliographic export, in order of preference.
COLUMN_NAMES = {
    "article_title": ["Article Title"],
    "author_keywords": ["Author Keywords"],
    "keywords_plus": ["Keywords Plus"],
    "abstract": ["Abstract"],
    "publication_year": ["Publication Year", "year"],
    "journal": ["Source Title", "Journal", "Publication Name"],
    "wos_category": ["WoS Categories"],
}
LIST_COLUMNS = ["model_specific_models", "model_secondary_tags", "material_categories"]
