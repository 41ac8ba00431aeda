"""Word lists, formats and constants that results depend on. Nothing here is computed."""

# --- fixed values -------------------------------------------------------------------------------------------------

STOPWORDS = (
    "a an and are as at be by do does for from how in is it of on or the to what when where which why with "
    "ao aos as como da das de dos e é em na nas no nos o os ou para por qual quais que se um uma"
).split()
NOISE = (
    "applies back behavior covers describe explain give identify list name protect state summarize tell using use "
    "aplica descreva diga estado liste nome protege resuma current currently latest atual atualmente vigente"
).split()
CURRENT_WORDS = "after current currently latest now replaced apos atual atualmente substituiu vigente".split()
HISTORICAL_WORDS = "before deprecated former historical old previous prior antes antigo anterior historico historica".split()

TASK_CODE = "função funcoes funções classe código codigo bug function class".split()
TASK_DECISION = "decisão decisao requisito constraint".split()
TASK_DECISION_PHRASE = "por que"
TASK_TEMPORAL = "quando versão versao antes depois atual".split()
TASK_KINDS = {
    "code": "code function class module symbol".split(),
    "docs": "documentation section knowledge".split(),
    "decision": "decision requirement constraint".split(),
    "temporal": "event version decision".split(),
}

STATUS_HISTORICAL = "historical deprecated superseded".split()
STATUS_CURRENT = "current active".split()

SENSITIVE_NAMES = ".env credentials credentials.json secrets.json id_rsa id_ed25519".split()
SENSITIVE_STEMS = "credentials credential secrets secret tokens".split()
SENSITIVE_PARTS = ".git .evigrain .venv node_modules".split()
DOCUMENT_SUFFIXES = ".md .markdown .txt .rst".split()

CHANNELS = ("exact", "fts", "morphology")
RRF_K, TOP_K, MAX_FACETS, PROTECTED, MAX_HOPS = 60, 50, 8, 2, 2
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
HOP_DECAY, VERSION_BOOST, SOURCE_CURRENT, SOURCE_OLD, TASK_BOOST = 0.55, 1.08, 1.03, 0.92, 1.08
EXPRESSION_RATIO, EPSILON = 0.70, 1e-12
REDUNDANCY, FACET_GAIN, CORE_GAIN, LEXICAL_GAIN, LENGTH_COST = 0.25, 0.010, 0.018, 0.004, 0.15
BOOST_SCALE, BOOST_LIMIT = 0.20, 0.10
DEFAULT_BUDGET, EVALUATION_BUDGET = 1200, 600

GENESIS = "GENESIS"
#: Prefixes of the ids of units and subjects that come from the nodes of a graph export.
NODE_ID, NODE_SUBJECT = "gene:graphify:", "locus:graphify:"
UNIT_FORMAT = "[GENE %s] %s\n%s\n[CITATION %s | %s | confidence=%.2f]"

GATES = {"token_savings": 0.25, "quality_margin": -0.02, "citation_accuracy": 0.95, "category_quality_margin": -0.10, "deterministic_stability": 1.0}
MINIMUM_QUESTIONS, BOOTSTRAP_ROUNDS = 30, 10_000
