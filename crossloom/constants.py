"""Defaults and fixed values. The texts below are data: results only match when they are equal to the letter."""

# Defaults of the operators.
MIN_INTERACTIONS = 3
MAX_SEQ_LEN = 15
SEED = 2040
PADDED_LEN = 15
K_TRAIN = 2
K_TEST = 3
NEIGHBOUR_ITEMS = 5
FEW_SHOT_ITEMS = 5
HISTORY_LINES = 15
PROFILE_LINES = 10
RECENT_ITEMS = 5
TOP_ATTRIBUTES = 10
TOP_CATEGORIES = 5
TOP_M = 5
KEPT_CANDIDATES = 20
CUTOFFS = (1, 5, 10, 20)
UHR_CUTOFFS = (1, 3, 5)
FUZZY_THRESHOLD = 0.5
COLD_THRESHOLD = 3
NEGATIVES = 999
PROMPT_WORDS = 512
TOKEN_LENGTH = 1024
GENERATION_BATCH = 8
IGNORED_LABEL = -100
RANK_TOLERANCE = 1e-5
NORM_EPSILON = 1e-8
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Domain labels.
DOMAIN_ALIASES = {"art": "Art", "entertainment": "Art", "office": "Office", "education": "Office"}
DOMAIN_LABELS = {"Entertainment": "Art", "Education": "Office"}
DOMAIN_X_NAME = "Entertainment"
DOMAIN_Y_NAME = "Education"
DEFAULT_USER_TOKENS = ["Game", "Movie"]

# Answer texts.
NO_SIMILAR_USERS_FOUND = "(no similar users found)"
NO_SIMILAR_USERS_AVAILABLE = "(no similar users available)"
EMPTY_SEQUENCE = "  (empty)"
SIMILAR_USER_PREFIX = "There is a similar user who has interacted with: "
NEIGHBOUR_PROMPT_PREFIX = "There is another similar user who has played arts or office before:"
RESPONSE_MARKER = "### Response:"
SYSTEM_MESSAGE = (
    "You are a cross-domain recommendation assistant. "
    "Based on user profiles and interaction history, "
    "recommend items that match user preferences."
)
INSTRUCTION_LINE = "Based on the user's interaction history and profile, recommend a new {target_domain} item."

# Prompt and profile templates.
ATTRIBUTE_EN = """You will serve as an assistant to help me extract attributes of the following item.
When given an item, you should first introduce the item briefly, then extract its key attributes as a list.

Item Title: {title}
Item Description: {description}
Item Category: {category}

Please respond in the following format:
INTRODUCTION: <brief introduction of the item>
ATTRIBUTES: ["attribute1", "attribute2", "attribute3", ...]
"""

ATTRIBUTE_ZH = """请根据以下物品的标题和描述，提取该物品的关键属性标签。

物品标题: {title}
物品描述: {description}
物品类别: {category}

请按以下格式回复:
介绍: <物品的简要介绍>
属性: ["属性1", "属性2", "属性3", ...]
"""

RECOMMEND_BASE = """Instruction: Based on the user's interaction history and profile information, recommend a new {target_domain} item that the user would likely enjoy.

Input:
{user_profile_text}

User Interaction History (chronological, newest last):
{interaction_sequence}

Please recommend ONE new {target_domain} item.
Output:"""

RECOMMEND_PROFILE = """Instruction: You are a recommendation assistant. Based on the user's profile, preferences, and interaction history, recommend a new {target_domain} item.

Input:
=== User Profile ===
{user_profile_text}

=== Interaction History ===
{interaction_sequence}

=== Preference Summary ===
- Preferred attributes: {preferred_attributes}
- Preferred categories: {preferred_categories}
- Similar items the user may like: {similar_items}

Please recommend ONE specific {target_domain} item title that matches the user's preferences.
Output:"""

RECOMMEND_COT = """Instruction: You are a cross-domain recommendation assistant. Analyze the user's interaction history and preferences step by step, then recommend a new {target_domain} item.

Input:
=== User Profile ===
{user_profile_text}

=== Interaction History ===
{interaction_sequence}

Think step by step:
1. What are the user's main interests based on their history?
2. What attributes and categories does the user prefer?
3. Based on these preferences, what {target_domain} item would be a good recommendation?

Please output ONLY the recommended item title after "Output:".
Output:"""

RECOMMEND_RETRIEVAL = """Instruction: Given a list of items the user has interacted with, along with some similar users who have similar interaction histories, please recommend a new {target_domain} item that the user would likely enjoy.

Input:
=== Similar Users ===
{retrieved_users_text}

=== Target User Interaction History ===
{interaction_sequence}

=== Target User Profile ===
{user_profile_text}

Please recommend ONE specific {target_domain} item title.
Output:"""

PROFILE_COMPACT = """Total interactions: {total_count}
Domain distribution: {domain_x_name}({x_count}), {domain_y_name}({y_count})
Recent items: {recent_items}"""

PROFILE_DETAILED = """User Behavior Summary:
- Total interactions: {total_count}
- {domain_x_name} domain: {x_count} items
- {domain_y_name} domain: {y_count} items
- Cross-domain ratio: {cross_ratio}

Top Preferred Attributes: {top_attributes}
Top Preferred Categories: {top_categories}

Similar Items (based on embedding): {similar_items}

Recent Interaction Sequence:
{recent_sequence}"""

INSTRUCTION_PROFILE = """Total interactions: {total_count}
Domain distribution: {domain_x_name}({x_count}), {domain_y_name}({y_count})
Top attributes: {top_attributes}
Top categories: {top_categories}"""

ALPACA_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
)
ALPACA_WITHOUT_INPUT = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:\n"
)
PLAIN_PROMPT = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
