"""Declared schemas of the file and message formats."""

EXAMPLES = (
    "config struct<source:string,tasks:array<string>,n_per_task:int,max_context_words:int>, "
    "examples array<struct<id:string,task:string,context:string,question:string,answers:array<string>>>"
)
EXTRA = (
    "struct<kv_compression_x:double,eff_bits:double,input_tokens:bigint,output_tokens:bigint,"
    "latent_tokens:bigint,decoder_prompt_tokens:bigint>"
)
ANSWERS = f"arm_group string, answers array<struct<id:string,arm:string,answer:string,extra:{EXTRA}>>, _bad string"
ARMS = (
    "examples array<struct<id:string,arms:map<string,"
    "struct<prompt:string,origin_tokens:bigint,compressed_tokens:bigint,retention:double>>>>"
)
TASK_LINES = "input string, context string, answers array<string>, line bigint"
PARAGRAPHS = "id string, question string, answer string, context struct<sentences:array<array<string>>>"
SQUAD = "id string, question string, context string, answers struct<text:array<string>>"
UTTERANCE = (
    "id string, text string, startMs bigint, endMs bigint, confidence double, speaker int, "
    "words array<struct<text:string,confidence:double,speaker:int,startMs:bigint>>"
)
MESSAGE = (
    "type string, is_final boolean, channel struct<alternatives:array<struct<transcript:string,"
    "words:array<struct<word:string,punctuated_word:string,confidence:double,speaker:int,"
    "start:double,end:double>>>>>"
)
WORDS = "array<struct<word:string,start_ms:bigint,end_ms:bigint>>"
EVENT = f"take string, seq bigint, type string, text string, start_ms bigint, end_ms bigint, speaker int, interim string, words {WORDS}"
MESSAGE_LINE = "take string, seq bigint, last boolean, at timestamp, value string"
