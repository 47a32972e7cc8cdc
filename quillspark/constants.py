"""Word lists, patterns and thresholds that results depend on. They are stated as they must be."""

# --- tokens and chunks
CHARS_PER_TOKEN = 4
CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
WORD_WINDOW, WORD_STEP = 512, 448
SLICE_WORDS = 512
SPARSE_BINS = 65536
SENTENCE_BREAK = r"(?<=[.!?])\s+|(?<=\n)\s*"
PARAGRAPH_BREAK = r"\n\s*\n"
HEADER = r"(?m)^(#{1,6}\s+.*)$"
#: Unicode words, as a Java pattern.
WORD = r"[\p{L}\p{N}_]+"
LATIN_WORD = r"[a-z0-9]+"
LLM_WINDOW_WORDS, LLM_WINDOW_OVERLAP = 1400, 2
PROMPT_CHARS = 16384
EXTRACTION_CHARS = 32000
SYNTHESIS_CONTEXTS, SYNTHESIS_CONTEXT_CHARS = 4, 1800

#: Formats of texts that other stages read.
CANDIDATE_TAG, PROSE_TAG, CODE_TAG = "[DIAGNOSIS CANDIDATE]", "[CLINICAL PROSE]", "(SNOMED"
EDGE_TAG = "GRAPH EDGE:"
SYNTHESIS_HEAD = "You are a {role}. Answer using ONLY the context. Cite source numbers. If missing, say so.\n\nCONTEXT:\n"
SYNTHESIS_QUESTION = "\n\nQUESTION: "
METADATA_WARNING = "metadata field '{key}' not in profile schema for domain '{domain}'"

# --- model output
CHANNEL_MARK = "<|channel|>"
FENCE = r"```(?:json)?\s*(.*?)```"
ARROW_TRIPLE = r'->\s*([^\s"][^\n]*?)\s+([A-Z][A-Z_]+)\s+([^\s"][^\n]*)'
PLAIN_TRIPLE = r"\b([A-Za-z0-9\-]+)\s+([A-Z][A-Z_]{2,})\s+([A-Za-z0-9\-]+)\b"
NAME_END = r"""[\s"'`.,;:]+$"""
NODE_NAMES, NODE_TYPES = ["id", "name", "entity", "label", "text"], ["type", "entity_type", "node_type"]
EDGE_SOURCES, EDGE_TARGETS = ["source", "from", "head", "subject"], ["target", "to", "tail", "object"]
EDGE_TYPES = ["type", "relation", "label", "relationship"]

# --- routing and grading
ID_TOKEN = r"\b[A-Za-z]{2,}-\d+\b"
FACTUAL_LEAD = r"(?i)^\s*(who|what|when|where|which)\b"
ANALYTICAL = r"(?i)\b(why|how|compare|analyz|impact|cause|explain|trade-?off|design|recommend)\w*\b"
FACTUAL_MAX_WORDS = 8
QUESTION_STOPWORDS = [
    "the", "a", "an", "of", "to", "is", "are", "was", "were", "and", "or", "in", "on", "for", "what", "who", "when",
    "where", "which", "how", "why", "does", "do", "did", "has", "have", "with", "that", "this",
]
ANSWER_STOPWORDS = [*QUESTION_STOPWORDS, "by", "be", "it", "as", "at", "from"]
GRADE_CORRECT, GRADE_AMBIGUOUS = 0.5, 0.2

# --- retrieval and fusion
ENTITY_MATCH = 0.88
CACHE_MATCH = 0.95
DUAL_BOOST, EDGE_BOOST = 0.15, 0.001
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.50, 0.15
RERANK_POOL, RERANK_TOP = 15, 5
GRAPH_LIMIT, PRUNE_TOP, GRAPH_ROWS = 50, 10, 5
KEYWORD_OVERLAP = 2
PAGERANK_DAMPING = 0.85
PAGERANK_TOLERANCE = 1e-6
PAGERANK_ROUNDS = 100

# --- terminology
KEYWORD_BREAK = r"\band\b|,|;"
KEYWORD_MIN = 3
CONCEPTS_PER_KEYWORD = 1500
EXPANSION_BOOST = 2.0
EXPANSION_RELATIONS = ["REL_246090004", "REL_47429007", "REL_363702006", "REL_116680003"]
DAY_WEIGHTS = [1.0, 1.5, 2.0, 2.5, 3.0]
DAY_POWER = 1.5

# --- transactions
ACCOUNT = r"(?:account|acct)\s+([a-z0-9_]+)"
VELOCITY = 10
RING_TEXT = "[FRAUD SIGNAL] Account {account} shares {kind} with account {peer} (possible collusion ring)."
VELOCITY_TEXT = "[FRAUD SIGNAL] Account {account} shows velocity spike: {n} outbound transactions (possible rapid-cycling fraud)."

# --- evaluation
ABSTENTIONS = [
    "does not contain", "does not describe", "does not mention", "not mentioned", "no information", "cannot answer",
    "cannot find", "context does not", "provided context does", "the context does not",
]
PURPOSES = [
    "describe", "pipeline", "system", "process", "handles", "manages", "provides", "enables", "implements", "defines",
    "configures", "monitors", "validates", "extracts", "runs", "uses", "connects", "stores", "queries", "generates",
]
SUPPORT, RELEVANT_COSINE, SHORT_TRUTH = 0.5, 0.35, 3
LOW_JACCARD, MARGINAL_JACCARD = 0.01, 0.03
ABBREVIATION = r"\b(e\.g|i\.e|etc|Dr|Mr|Ms|vs)\."
TEMPLATE_QUESTION = r"what does the (.+?) (document|file|note|md) describe"

#: What a release must reach: means at least, 95th percentiles at most.
GATES_LEAST = {"faithfulness": 0.85, "context_precision": 0.50}
GATES_MOST = {"retrieval_p95_ms": 1100.0, "synthesis_p95_s": 3.0}

# --- dynamic labels
RELATION_FRAGMENTS = [
    "is ", "are ", "was ", "were ", "uses", "used", "use ", "offers", "offered", "results", "result ", "outperforms",
    "outperformed", "measured", "measures", "tested", "tests", "test ", "calculated", "calculates", "collapsed",
    "approach", "compared", "compared to", "leads", "leading", "provides", "provided", "enables", "enabled",
]
PROMOTE_AT, LABEL_CAP = 3, 20
DRIFT_HIGH, DRIFT_LOW = 15.0, 5.0

# --- synchronisation
FOLDER_DOMAINS = [
    ("eng/", "engineering"), ("engineering/", "engineering"), ("journal/", "journal"), ("papers/", "journal"),
    ("legal/", "legal"), ("medical/", "medical"), ("accounting/", "accounting"), ("hospitality/", "hospitality"),
]
DEFAULT_DOMAIN = "engineering"
TEXT_SUFFIXES = [".md", ".txt", ".markdown", ".rst", ".json", ".csv", ".log", ".yaml", ".yml"]
BATCH_SUFFIXES = [".md", ".txt", ".markdown"]

# --- metrics
LATENCY_BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0, float("inf")]
#: Size of quantile sketches.
SKETCH_SIZE = 400
