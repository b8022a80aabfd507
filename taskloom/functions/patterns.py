"""Word lists, patterns, thresholds and labels.

Everything in this file is a fixed value that results depend on. Patterns are
plain regular expressions tested in list order; ``text.rx`` adds the Unicode
flag before they reach Spark.
"""

# --- fixed values: message filtering ---------------------------------------
SKIP_TAGS = [
    r"^<local-command",
    r"^<command-name>",
    r"^<system-reminder>",
    r"^<task-notification>",
    r"^<teammate-message>",
    r"^\s*$",
]
BASIC_SKIP_TAGS = [r"^<local-command", r"^<command-name>", r"^<system-reminder>", r"^\s*$"]
GENERATED_TEXT = [
    r"^This session is being continued from a previous conversation",
    r"^# Iteration workflow",
    r"^Implement the following plan:",
    r"^\[Request interrupted",
    r"^<summary>",
    r"^Analysis:",
]
PLAN_PROMPT = r"(?i)^Implement the following plan:"
INTERRUPT_PROMPT = r"^\[Request interrupted"
SLASH_COMMAND = r"^<command-(?:name|message)>|^/\w+"
BARE_ACKS = [
    "continue", "ok", "yes", "go ahead", "proceed", "sure",
    "sounds good", "yep", "yeah", "ok.", "yes.", "sure.",
]

# --- fixed values: outcome from the next user message (pattern, evidence) ---
PLEASED = [
    (r"\bthanks?\b", "thanks"),
    (r"\bthank you\b", "thank you"),
    (r"\bperfect\b", "perfect"),
    (r"\bgreat\b", "great"),
    (r"\bawesome\b", "awesome"),
    (r"\blooks good\b", "looks good"),
    (r"\bnice\b", "nice"),
    (r"\bthat works\b", "that works"),
    (r"\bexactly\b", "exactly"),
    (r"^lgtm\b", "lgtm"),
    (r"\bgood job\b", "good job"),
]
DISPLEASED = [
    (r"\bwrong\b", "wrong"),
    (r"\btry again\b", "try again"),
    (r"\bnot what\b", "not what"),
    (r"\bincorrect\b", "incorrect"),
    (r"\bthat's not\b", "that's not"),
    (r"\bno[,.]?\s+(?:that|this)\b", "no, that/this"),
    (r"\bundo\b", "undo"),
    (r"\brevert\b", "revert"),
    (r"\bfix\b", "fix (potential)"),
]
QUESTION_ABOUT_FIX = r"\b(will|can|could|would|should|does|is there|any)\b.*\b(fix|wrong)\b"
CARRYING_ON = [
    (r"\balso\b", "also"),
    (r"\band\s+(?:can|could|please)\b", "and can/could"),
    (r"\bone more\b", "one more"),
    (r"\bactually\b", "actually"),
    (r"\bwait\b", "wait"),
    (r"\bbut\b", "but"),
    (r"\bhmm\b", "hmm"),
]

# --- fixed values: completion signal of the basic segmentation --------------
DONE_SIGNALS = [
    r"\bthanks?\b", r"\bthank you\b", r"\bperfect\b", r"\bgreat\b", r"\bawesome\b",
    r"\blooks good\b", r"\bnice\b", r"\bgot it\b", r"\bthat works\b", r"\bexactly\b",
]
UNHAPPY_SIGNALS = [
    r"\bwrong\b", r"\btry again\b", r"\bnot what\b", r"\bincorrect\b",
    r"\bno[,.]?\s*(that|this)\b", r"\bactually\b", r"\bthat's not\b",
]

# --- fixed values: dissatisfaction between two edits ------------------------
DISSATISFIED_BETWEEN = [
    r"\bwrong\b", r"\btry again\b", r"\bnot what\b", r"\bincorrect\b",
    r"\bthat's not\b", r"\bno[,.]?\s+(?:that|this)\b", r"\bundo\b", r"\brevert\b",
    r"\bfix (?:that|this|it)\b", r"\bbreak\b", r"\bbroke\b",
]

# --- fixed values: error text in tool results -------------------------------
ERROR_TEXT = [
    r"error", r"failed", r"FAIL", r"traceback", r"exception",
    r"SyntaxError", r"TypeError", r"NameError", r"ImportError",
    r"is_error.*true", r"tool_use_error", r"exit code [1-9]",
    r"compilation failed", r"build failed",
]
SHELL_FILE_CHANGE = r"\b(sed|tee|>>|>\s)\b"

# --- fixed values: task types, tested in this order -------------------------
TASK_TYPES = {
    "continuation": [
        r"^continue\.?\.?\.?$", r"^\[request interrupted", r"^ok\.?$", r"^yes\.?$",
        r"^no\.?$", r"^go ahead", r"^proceed", r"^<task-notification>",
        r"^<teammate-message>", r"^This session is being continued", r"^sure\.?$",
        r"^sounds good", r"^yep", r"^yeah",
    ],
    "investigation": [
        r"\b(investigate|explore|understand|explain|what is|how does|where is|find out|look at|analyze|research|review|compare|check)\b",
        r"\b(show me|tell me about|describe|summarize|list)\b",
        r"^(what|where|how|why|can you|is there)\b",
        r"\b(deep investigation|deep dive)\b",
    ],
    "bugfix": [
        r"\b(fix|bug|broken|error|issue|wrong|doesn't work|not working|fails|crash|exception)\b",
        r"\b(debug|troubleshoot|diagnose|resolve)\b",
    ],
    "refactor": [
        r"\b(refactor|restructure|reorganize|clean ?up|simplify|rename|move|extract|consolidate)\b",
        r"\b(split|merge|dedupe|deduplicate|factor out|remove|removing)\b",
    ],
    "port": [
        r"\b(port|convert|migrate|translate|rewrite in|switch to)\b",
        r"\b(from .+ to .+)\b",
    ],
    "greenfield": [
        r"\b(create|new|implement from scratch|build|scaffold|bootstrap|initialize|setup|set up)\b",
        r"^(make|write|create|build|implement)\s+(a|an|the|new)\b",
    ],
    "feature": [
        r"\b(add|implement|feature|enhance|extend|support|enable|allow|include)\b",
        r"\b(integrate|hook up|wire up|connect)\b",
        r"implement the following plan",
        r"\bshould be\b",
        r"\buse .+ instead of\b",
        r"\bmake it\b",
        r"\bswap\b",
    ],
    "sysadmin": [
        r"\b(git|commit|push|pull|merge|rebase|branch|deploy|install|configure|docker|npm|pip|chmod|chown)\b",
        r"\b(server|service|daemon|cron|systemd|nginx|apache)\b",
        r"^(run|execute|start|stop|restart|try|test|build)\b",
        r"\blet's try\b",
        r"\brun \d+ instance",
        r"\bnot working\b",
        r"\bdoesn't seem to be\b",
    ],
    "docs": [
        r"\b(document|readme|comment|docstring|jsdoc|explain in|write up|changelog)\b",
        r"\b(update docs|add documentation)\b",
    ],
}
TYPE_NAMES = list(TASK_TYPES) + ["unknown"]

# --- fixed values: complexity (level, max tools, max files, max lines) ------
COMPLEXITY_LIMITS = [
    ("trivial", 3, 1, 20),
    ("simple", 10, 3, 100),
    ("moderate", 30, 10, 500),
    ("complex", 80, 25, 2000),
]
COMPLEXITY_ORDER = ["trivial", "simple", "moderate", "complex", "major"]
COMPLEXITY_WORDS = [
    ("trivial", r"\b(quick|simple|just|only)\b"),
    ("major", r"\b(overhaul|rewrite|major|massive|huge)\b"),
    ("complex", r"\b(comprehensive|full|complete|entire)\b"),
]
TESTED_COMPLEXITIES = ["trivial", "simple", "moderate", "complex"]

# --- fixed values: domains by file path -------------------------------------
DOMAINS = {
    "frontend": [r"\.(tsx?|jsx?|vue|svelte|css|scss|html)$", r"(components?|pages?|views?|ui)/"],
    "backend": [r"\.(py|go|rs|java|rb|php)$", r"(api|server|services?|handlers?)/"],
    "devops": [r"(docker|kubernetes|terraform|ansible|\.ya?ml$|Makefile|\.sh$)", r"(deploy|infra|ci)/"],
    "data": [r"\.(sql|csv|json|parquet)$", r"(data|models?|schemas?|migrations?)/"],
    "docs": [r"\.(md|rst|txt|org)$", r"(docs?|readme)/i"],
}

# --- fixed values: keyword signals ------------------------------------------
POSITIVE_WORDS = [
    r"\bthanks?\b", r"\bthank you\b", r"\bgreat\b", r"\bperfect\b", r"\bexcellent\b",
    r"\bawesome\b", r"\blooks? good\b", r"\bnice\b", r"\bwell done\b", r"\bexactly\b",
    r"\blove it\b", r"\bbeautiful\b", r"\bwonderful\b", r"\bgood job\b", r"\bimpressive\b",
]
NEGATIVE_WORDS = [
    r"\bno[\s,]", r"\bwrong\b", r"\bincorrect\b", r"\bthat's not\b", r"\bdon't\b",
    r"\bshouldn't\b", r"\binstead\b", r"\bactually\b",
    r"\bplease (fix|change|undo|revert|remove)\b", r"\bnot what i\b", r"\bstop\b",
    r"\bwhy did you\b", r"\bundo\b", r"\brevert\b",
]
CONTINUING_WORDS = [
    r"\bnow\b", r"\bnext\b", r"\balso\b", r"\bcan you\b", r"\bplease\b",
    r"\bwhat about\b", r"\bhow about\b",
]
CORRECTION_WORDS = [
    r"\bno[\s,]\s*(change|make|use|set|do)\b", r"\b(change|make|set)\s+it\s+to\b",
    r"\binstead\s+(of|use)\b", r"\bshould\s+(be|have)\b",
    r"\bthat's\s+not\s+(right|correct|what)\b", r"\bwrong\b", r"\bincorrect\b",
    r"\bundo\b", r"\brevert\b", r"\bfix\s+(the|this|that|it)\b",
]

# --- fixed values: votes that normalise free-text annotations ---------------
QUALITY_VOTES = {
    "excellent": [
        r"\bexcellent\b", r"\bexceptional\b", r"\boutstanding\b", r"\bperfect(ly)?\b",
        r"\bflawless\b", r"\bsuperb\b", r"\bvery well\b", r"\bhigh quality\b", r"\bexpertly\b",
    ],
    "good": [
        r"\bgood\b", r"\bwell[\s-]executed\b", r"\bsolid\b", r"\bcompetent\b",
        r"\beffective(ly)?\b", r"\bstrong\b", r"\bsuccessful(ly)?\b", r"\bcapable\b",
        r"\bproficient\b", r"\bsmooth(ly)?\b", r"\befficient(ly)?\b",
    ],
    "adequate": [
        r"\badequate\b", r"\bacceptable\b", r"\breasonable\b", r"\bsatisfactor(y|ily)\b",
        r"\bokay\b", r"\bdecent\b", r"\bmoderate(ly)?\b", r"\bfair(ly)?\b",
        r"\bsufficient\b", r"\bbasic(ally)?\b", r"\bstandard\b",
    ],
    "poor": [
        r"\bpoor(ly)?\b", r"\binadequate\b", r"\bsubpar\b", r"\bweak\b", r"\bstrugg",
        r"\binefficient\b", r"\bproblematic\b", r"\bsuboptimal\b", r"\bmisalign",
        r"\bmissed\b", r"\bincorrect\b",
    ],
    "failed": [
        r"\bfail(ed|ure)?\b", r"\bunsuccessful\b", r"\bdid not complete\b",
        r"\bcould not\b", r"\bunable to\b", r"\bbroken\b",
    ],
}
WORK_VOTES = {
    "investigation": [
        r"\binvestigat", r"\bexplor", r"\bresearch", r"\banalysi[sz]", r"\breview",
        r"\bunderstand", r"\bexamin", r"\bdiagnos", r"\bdebug",
        r"\blook(ed|ing)?\s+(at|into)\b", r"\bfind(ing)?\b",
        r"\bread(ing)?\s+(and|the|through)\b", r"\bsearch",
    ],
    "directed_impl": [
        r"\bimplement(ed|ing)?\b.*\b(requested|asked|specified)\b",
        r"\bfollow(ed|ing)?\s+(the\s+)?instruction", r"\bdirect(ed|ly)\s+implement",
        r"\bsimple\s+(change|edit|fix|update|modification)",
        r"\bstraightforward\b.*\b(implement|change|update)",
        r"\bminor\s+(change|edit|fix|update|tweak)",
    ],
    "creative_impl": [
        r"\bcreativ", r"\bdesign(ed|ing)?\b", r"\barchitect", r"\bgreenfield\b",
        r"\bfrom\s+scratch\b", r"\bnew\s+(feature|system|module)",
        r"\bbuild(ing)?\s+(a|an|the|new)\b", r"\bcomplex\s+implement",
        r"\bsubstantial\b", r"\blarge[\s-]scale\b",
    ],
    "verification": [
        r"\bverif(y|ied|ication)\b", r"\btest(ed|ing)?\b", r"\bvalidat",
        r"\bcheck(ed|ing)?\b", r"\bconfirm", r"\baudit", r"\binspect",
    ],
    "correction": [
        r"\bcorrect(ed|ion|ing)?\b", r"\bfix(ed|ing)?\b", r"\brepair",
        r"\bresolv(e|ed|ing)\b", r"\bpatch", r"\bbug\s*fix",
        r"\baddress(ed|ing)?\b.*\b(issue|error|bug)", r"\brefactor",
    ],
}
SENTIMENT_VOTES = {
    "satisfied": [
        r"\bsatisf(ied|action)\b", r"\bpositive\b", r"\bhappy\b", r"\bpleased\b",
        r"\bapprov", r"\bappreciat", r"\bthanks?\b", r"\bgrateful\b", r"\bimpressed\b",
        r"\bcontent\b", r"\bdelighted\b",
    ],
    "neutral": [
        r"\bneutral\b", r"\bunclear\b", r"\bambiguous\b", r"\bno\s+(clear\s+)?sentiment\b",
        r"\bsession\s+end", r"\bno\s+explicit\b", r"\bno\s+direct\b", r"\bmixed\b",
        r"\bindeterminate\b",
    ],
    "dissatisfied": [
        r"\bdissatisf", r"\bnegative\b", r"\bfrustrat", r"\bunhappy\b", r"\bdispleas",
        r"\bdisappoint", r"\bcorrect(ion|ive)\b", r"\bwrong\b",
    ],
    "ambiguous": [
        r"\biterativ", r"\bcollaborativ", r"\brefinement\b", r"\bcontinuing\b",
        r"\bfollow[\s-]up\b", r"\bongoing\b",
    ],
}
SENTIMENT_SUBSTRINGS = [
    ("dissatisfied", ["dissatisfied", "negative", "frustrated"]),
    ("satisfied", ["satisfied", "positive"]),
    ("neutral", ["neutral", "unclear"]),
    ("collaborative", ["collaborative", "iterative", "refinement"]),
]
COMPLETIONS = ["complete", "partial", "interrupted", "failed"]

# --- fixed values: agents and planning --------------------------------------
AGENT_WORDS = [
    "subagent", "agent", "parallel", "delegate", "spawn",
    "dispatch", "concurrent", "in parallel",
]
PLANNING_WORDS = [
    "plan", "approach", "strategy", "design", "how should",
    "what's the best way", "think through",
]
PARALLEL_WORDS = ["parallel", "concurrently", "simultaneously"]
USE_AGENT_PATTERNS = [
    r"\b(subagents?|agents?)\b.*\b(to|for)\b",
    r"\buse\b.*\b(subagents?|agents?)\b",
    r"\bspawn\b|\bdelegate\b|\bdispatch\b",
]
RESEARCH_TOOLS = ["Read", "Grep", "Glob", "Task", "WebSearch", "WebFetch"]
WRITE_TOOLS = ["Edit", "Write", "NotebookEdit"]

# --- fixed values: price per million tokens, and report constants -----------
DEFAULT_PRICE = {"input": 15.0, "output": 75.0, "cache_read": 1.875, "cache_write": 18.75}
GAP_THRESHOLDS_MIN = [2, 5, 10, 20, 30, 60]
DURATION_BUCKETS = [
    ("under_30s", 0.0, 30.0),
    ("30s_to_2m", 30.0, 120.0),
    ("2m_to_10m", 120.0, 600.0),
    ("10m_to_1h", 600.0, 3600.0),
    ("over_1h", 3600.0, None),
]
SESSION_BUCKETS = [("short (1-3)", 3), ("medium (4-8)", 8), ("long (9+)", None)]
CATEGORICAL_FIELDS = [
    "task_completion", "normalized_user_sentiment", "scope_management", "iteration_required",
    "error_recovery", "communication_quality", "normalized_execution_quality", "autonomy_level",
]
CONTINUOUS_FIELDS = [
    "alignment_score", "duration_seconds", "tool_calls", "files_touched",
    "lines_added", "lines_removed", "lines_per_minute", "tools_per_file",
]
PROPORTION_FIELDS = {
    "satisfaction_rate": ("normalized_user_sentiment", "satisfied"),
    "dissatisfaction_rate": ("normalized_user_sentiment", "dissatisfied"),
    "complete_rate": ("task_completion", "complete"),
    "failed_rate": ("task_completion", "failed"),
    "scope_expanded_rate": ("scope_management", "expanded"),
    "one_shot_rate": ("iteration_required", "one_shot"),
    "good_execution_rate": ("normalized_execution_quality", "good"),
}
