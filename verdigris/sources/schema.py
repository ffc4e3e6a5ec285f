"""Schemas of prompts, scored records and grid tables."""

RECORD = """run_id string, phase string, cluster string, prompt_id string, dataset string, split string, prompt string, question string, reference_answers array<string>,
 model string, model_tier string, entailment_backend string, decoding struct<num_samples: int, temperature: double, top_p: double, top_k: int, max_new_tokens: int, seed: int>,
 sampled_answers array<string>, normalized_answers array<string>, semantic_clusters array<int>, cluster_representatives array<string>, scores map<string, double>, correctness_label boolean,
 sequence_logprobs array<double>, most_likely_answer string, sep_greedy_answer string, sep_hidden_state array<double>, hidden_states array<array<double>>"""
PROMPT = "prompt_id string, dataset string, split string, prompt string, reference_answers array<string>, question string, source_index long"
QUESTION = "QuestionId string, Question string, Answer struct<Value: string, Aliases: array<string>>, source_index long"
ARITHMETIC = "ID string, Body string, Question string, Answer double, source_index long"
MEASUREMENT = """arm string, condition string, instruction string, n_demonstrations int, split_role string, dataset string, model string, seed int, temperature double, entailment_backend string,
 grader string, method string, n_records long, mean_answer_chars double, accuracy double, auroc double, aurac_paper double, aurac_mean_retained double"""
FEATURE = """protocol string, feature_response_decoding string, token_selection string, layer_selection string, generation_termination string, generation_config_source string,
 sampling_temperature double, sampling_top_p double, sampling_top_k int, sampling_num_responses int, sampling_max_new_tokens int, feature_response_max_new_tokens int,
 model_id string, model_revision string, tokenizer_id string, tokenizer_revision string, hidden_layer int, hidden_dimension int, base_seed long, prompt_seed long,
 greedy_degenerate_excluded boolean, feature_token_basis string, feature_backfill struct<method: string, token_selection: string, model_id: string, model_revision: string, hidden_layer: int>,
 termination_token_ids array<int>, terminating_special_token_id int, generated_content_token_index int, full_sequence_token_index int, sampled_eos_or_eot_count int, sampled_max_new_tokens_count int"""
