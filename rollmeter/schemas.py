"""Schemas of the input tables, as Spark reads them."""

from __future__ import annotations

from . import constants as K

WIDE = ("problem_id string, question string, answer string, difficulty double, supervision_status string, " + ", ".join(f"supervision_{c} string" for c in K.ALL_CONDITIONS))
LONG = ("problem_id string, condition string, prompt string, question string, answer string, output string, target string, difficulty double")
SPLITS = ("train array<string>, dev array<string>, test array<string>, `group` map<string,string>, base_pass4 map<string,double>, seed bigint")
RECORD = (
    "problem_id string, model string, condition string, sample_index bigint, seed bigint, verified_answer string, input_tokens bigint, generated_tokens bigint, max_new_tokens bigint, finish_reason string, hit_length_cap boolean, "
    "answer_extracted string, output string, output_token_ids array<int>, correct boolean, rescued boolean, rescued_max_new_tokens bigint, rescued_generated_tokens bigint, rescued_finish_reason string, rescued_answer_extracted string, "
    "rescued_output string, rescued_correct boolean, rescued_output_token_ids array<int>, correct_full boolean, mode string, thinking boolean, adapter_dir string"
)
PROFILE = (
    "problem_id string, sample_index bigint, condition string, correct boolean, position bigint, normalized_position double, token_category string, region string, logp double, logp_student double, log_ratio double, entropy double, "
    "entropy_student double, top1_agree_with_student boolean, is_correction_marker boolean, eos_prob double, eos_prob_student double, think_close_prob double, think_close_prob_student double, answer_transition_prob double, "
    "answer_transition_prob_student double, full_kl double, token_id bigint, clipped_kl double, pi_length_tokens double"
)
PREFIX_SCORES = ("problem_id string, condition string, position bigint, logp double, logp_none double, log_ratio double, entropy double, entropy_none double, top1_agree_with_none boolean, is_correction_marker boolean, region string, full_kl double")
BENCHMARK = ("problem_id string, question string, verified_answer string")
ANCHOR = ("average_at_n_pct double, results array<struct<problem_id:string,num_correct:bigint,ground_truth:string,problem:string>>")
TRAJECTORY = (
    "run_name string, step bigint, problem_id string, condition string, seed bigint, batch_position bigint, completion string, completion_tokens bigint, finish_reason string, mean_token_kl double, mean_clipped_token_kl double, "
    "mean_sampled_token_log_ratio double, loss double, correct_before_update boolean, loss_support_windows array<array<int>>, n_loss_support_tokens bigint, support_coverage_frac double"
)
TIMINGS = ("job_id string, cell string, lane string, seconds double, rc int")
JOB = ("job_id string, priority int, cell string, run string, enable_thinking boolean, adapter_dir string, runs_config array<struct<name:string,adapter_root:string,checkpoint_steps:array<int>>>, est_requests bigint, expected_output string, model string")
