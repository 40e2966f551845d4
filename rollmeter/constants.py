"""Fixed values that results depend on."""

# Condition names, in the order of the long layout; density order of the views.
CONDITIONS = ("answer_only", "key_points", "full_trace")
EXTRA_CONDITIONS = ("gist", "summary", "clean_solution")
ALL_CONDITIONS = CONDITIONS + EXTRA_CONDITIONS
VIEWS = ("answer_only", "gist", "key_points", "clean_solution", "summary", "full_trace")
BASELINE_PROFILE, BASELINE_GENERATION = "none", "no_pi"

# Words that mark a correction.
CORRECTION_MARKERS = ("wait", "but", "however", "maybe", "actually", "recheck", "check", "verify", "reconsider", "mistake", "instead")

# Context and budgets in tokens.
MAX_LENGTH, MARGIN = 32768, 256
MAIN_CAP, RESCUE_CAP, REFERENCE_CAP = 16384, 32512, 8192
BUDGETS = (4096, 8192, 16384)
LEAST_COMMON = 512

# Seeds, samples and resampling.
SEED_PER_MODEL, SEED_PER_SAMPLE = 1_000_000, 10_000
MODEL_INDEX = {"Qwen/Qwen3-1.7B": 0, "HuggingFaceTB/SmolLM3-3B": 2}
BOOT_REPLICATES = 10_000
SEED_ESTIMATOR, SEED_PROFILE, SEED_EXTERNAL = 20260810, 42, 0
QUOTAS = {"train": 512, "dev": 64, "test": 128}
GROUPS = ("easy", "frontier", "hard_recoverable")

# Profile reduction and losses.
POSITION_BINS, PROBABILITY_EPS, TOKEN_CLIP = 50, 1e-7, 0.05
STOP_SIGNALS = ("eos_prob", "think_close_prob", "answer_transition_prob")

# Decontamination.
SHINGLE, FLAG_CONTAINMENT = 8, 0.5

# Record linkage.
LEAST_RATIO, LEAST_MARGIN = 0.5, 0.15

# Prompt texts; {question}, {answer} and {reference} are filled in.
ANSWER_SENTENCE = "The final answer is \\boxed{{answer}}."
STUDENT_PROMPT = "Solve the following math problem. Reason step by step, and put the final answer in \\boxed{}.\n\nProblem:\n{question}"
TEACHER_PROMPT = STUDENT_PROMPT + (
    "\n\nPrivileged reference available only to the teacher:\n<reference>\n{reference}\n</reference>\n\n"
    "Use the reference to help solve or evaluate the problem, but do not mention that a reference was provided."
)
OFFICIAL_ENDING = "\n\nPlease reason step by step, and put your final answer within \\boxed{}."
OFFICIAL_STUDENT_PROMPT = "Problem: {question}" + OFFICIAL_ENDING
OFFICIAL_EVALUATOR_PROMPT = "{question}" + OFFICIAL_ENDING
OFFICIAL_TEACHER_PROMPT = (
    "Problem: {question}\n\nHere is a reference solution to this problem:\n=== Reference Solution Begin ===\n{reference}\n=== Reference Solution End ===\n"
    "\n\nAfter reading the reference solution above, make sure you truly understand the reasoning behind each step — do not copy or paraphrase it. "
    "Now, using your own words and independent reasoning, derive the same final answer to the problem above. "
    "Think step by step, explore different approaches, and don't be afraid to backtrack or reconsider if something doesn't work out:\n"
    "\nPlease reason step by step, and put your final answer within \\boxed{}."
)

# Sampling by protocol (temperature, top_p, top_k, repetition_penalty).
SAMPLING = {"local": (1.0, 0.95, 20, 1.0), "official": (1.0, 0.95, -1, 1.0)}
