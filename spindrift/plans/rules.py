"""Rules as data: vocabularies, header spellings, thresholds, causes, advice, comparison metrics.

Everything here is a fixed value: results depend on these words and numbers being what they are. Code that applies them is elsewhere.
"""

from __future__ import annotations

CATEGORIES = ["compute", "comm", "copy", "schedule", "other"]

# Words of each subtype, in order of precedence. "bounded" words stand between non-letters, the others anywhere.
COMM_WORDS = [
    ("allreduce", "bounded", "all_?reduce|hcclallreduce|hcom_allreduce|reduce_?scatter|hcclreducescatter|hcom_reduce_scatter"),
    ("allgather", "bounded", "all_?gather|hcclallgather|hcom_allgather|_allgather_base"),
    ("alltoall", "bounded", "all_?to_?all|all2all|hcclalltoall|hcom_alltoall|alltoallv|dispatch|combine"),
    ("broadcast", "bounded", "broadcast|hcclbroadcast|hcom_broadcast"),
    ("sendrecv", "bounded", "send|recv|isend|irecv|p2p|batchsendrecv|hcclsend|hcclrecv"),
    ("barrier", "bounded", "barrier|hcclbarrier"),
    ("notify", "anywhere", r"notify[_\s-]?wait|notify[_\s-]?record|wait[_\s-]?notify|hcom_notify"),
    ("generic", "bounded", "hccl|hcom_|mc2|all_?reduce_?mc2|moe_?distribute"),
]
COPY_WORDS = [
    ("h2d", "anywhere", r"h2d|host[_\s-]?to[_\s-]?device|memcpy_?host2device|aclrtmemcpyh2d"),
    ("d2h", "anywhere", r"d2h|device[_\s-]?to[_\s-]?host|memcpy_?device2host|aclrtmemcpyd2h"),
    ("d2d", "anywhere", r"d2d|device[_\s-]?to[_\s-]?device|memcpy_?device2device"),
    ("p2p", "anywhere", r"p2p|peer[_\s-]?to[_\s-]?peer|kv[_\s-]?transfer|pull[_\s-]?kv|push[_\s-]?kv"),
    ("other", "bounded", "memcpy|memcopy|aclnnmemcpy|aclrtmemcpy|copy_?async|_to_copy|movement|dma_copy"),
]
COMPUTE_WORDS = [
    ("attention", "anywhere", r"flash[_\s-]?attention|\bfa\b|attention|paged_attention|unified_attention|mla|incremental|prompt_flash|decode_attention|attn"),
    ("matmul", "anywhere", r"matmul|mat_?mul|gemm|batchmatmul|linear|addmm|mm\b|fc\b|grouped_?matmul|gmm|quant_?matmul"),
    ("moe", "anywhere", "moe|expert|topk|top_k|gate|router|shared_expert"),
    ("norm", "anywhere", r"rms_?norm|layer_?norm|norm\b|batchnorm"),
    ("activation", "anywhere", "silu|gelu|relu|sigmoid|tanh|swiglu|swish|activation|softmax|log_?softmax"),
    ("quant", "anywhere", "quant|dequant|dynamic_?quant|per_?token|int8|int4|fp8|w8a8|antiquant"),
    ("reduce", "anywhere", "reduce_?(?:sum|max|mean|min)|cumsum|argmax|argmin"),
    (
        "elementwise",
        "bounded",
        "add|sub|mul|div|pow|exp|log|sqrt|rsqrt|cast|transpose|permute|reshape|slice|concat|split|pad|gather|scatter|index|select|where|masked|clip|clamp|neg|abs|sign|copy|fill|zeros|ones|embedding|rope|rotary",
    ),
    ("conv", "anywhere", r"conv\d?d?|convolution|pool"),
]
FRAMEWORK_WORDS = [
    ("engine", "anywhere", r"execute_model|model_runner|model\.forward|forward\b|scheduler|prepare_input|prepare_inputs|profile_run|warmup|dummy_run"),
    ("sampler", "anywhere", r"sampler|sampling|logits|_to_list|\.item\(|tolist|argmax_sample|penalties|top_?p|top_?k_?sample"),
    ("python", "anywhere", r"^python|py::|python_function|__call__|nn\.module|\bmodule\b"),
    ("aten", "anywhere", "^(?:aten::|torch_npu::|torch::|vllm::|aclnn)"),
    ("sync", "anywhere", "synchronize|stream_?sync|device_?sync|aclrt_?synchronize|wait_?event|event_?record"),
    ("memory", "anywhere", r"block_manager|block_table|kv_cache|allocate|malloc|free\b|cache_engine"),
]
EXPLICIT_COMM = "hccl|communication|collective"
DEVICE_TASKS = "aicore|ai_core|aicpu|kernel|npu"
AI_CPU = "aicpu|ai_cpu"
CPU_KERNEL = "cpu_?(?:kernel|op|fallback|impl)|_cpu|cpukernel"
MARKER_NAMES = "mstx|marker|profiler_?step"
PREFILL_TEXT, DECODE_TEXT = "prefill|prompt|chunked_?prefill|context_?phase", "decode|generation|generating|token_?phase"
MARKERS = "^(?:mstx|marker|step|iteration|prefill|decode)|prefill|decode"
SYNC_OPS = "item|tolist|to_list|local_scalar_dense|synchronize|numpy"
ENGINE_STEPS = r"execute_model|model_runner|model\.forward|engine_?step|run_model|forward_pass"
SUBTYPE_LABELS = {
    ("comm", "allreduce"): "all-reduce", ("comm", "allgather"): "all-gather", ("comm", "reducescatter"): "reduce-scatter", ("comm", "alltoall"): "all-to-all",
    ("comm", "broadcast"): "broadcast", ("comm", "sendrecv"): "send/receive", ("comm", "barrier"): "barrier", ("comm", "notify"): "notify/wait", ("comm", "generic"): "other collective",
    ("copy", "h2d"): "host to device", ("copy", "d2h"): "device to host", ("copy", "d2d"): "device to device", ("copy", "p2p"): "peer to peer", ("copy", "other"): "other copy",
    ("compute", "matmul"): "matrix multiply", ("compute", "attention"): "attention", ("compute", "moe"): "experts", ("compute", "norm"): "normalisation", ("compute", "activation"): "activation",
    ("compute", "quant"): "quantisation", ("compute", "reduce"): "reduction", ("compute", "elementwise"): "elementwise", ("compute", "conv"): "convolution", ("compute", "other"): "other compute",
    ("schedule", "engine"): "engine", ("schedule", "sampler"): "sampling", ("schedule", "python"): "Python", ("schedule", "aten"): "dispatch", ("schedule", "sync"): "synchronisation",
    ("schedule", "memory"): "memory management", ("schedule", "aicpu"): "AI CPU", ("schedule", "cpu-kernel"): "CPU kernel", ("schedule", "host-other"): "other host work",
}

# Parts that a name loses on its way to an aggregation key, and collectives' own names.
NAME_PREFIX = r"^(?:aten::|torch_npu::|torch::|vllm::|nn\.modules?\.|c10::|aclnn)"
NAME_HASH = r"_[0-9a-f]{8,}$"
NAME_INSTANCE = r"(?:_+\d+){1,4}$"
NAME_WRAPPER = r"^(?:hcom[_-]|hccl[_-]?)"
NAME_COLLECTIVES = [("^all[_-]?reduce", "AllReduce"), ("^all[_-]?gather", "AllGather"), ("^reduce[_-]?scatter", "ReduceScatter"), ("^all[_-]?to[_-]?all", "AlltoAll"), ("^broadcast", "Broadcast")]
NAME_ENDINGS = [r"\.(?:default|out|input|Tensor|Scalar)$", r"\((?:x\d+|\d+)\)$", r"[,\s]+$"]
UNNAMED = "(unnamed)"

# Labels of processes, device first.
DEVICE_LABELS = "ascend hardware|ascend_hardware|aicore|ai core|ai_core|aicpu|ai_cpu|device|npu"
HOST_LABELS = "^(?:python|cann|communication|hccl|overlap analysis|python gc|gc|host|cpu|main|worker|dequeue|enqueue|fwdbwd)"

# Argument keys of trace events, in order.
ARG_KEYS = {
    "shapes_in": ["input dims", "input_dims", "input shapes", "input_shapes", "inputshape", "input shape", "args.input dims", "args.input shapes"],
    "shapes_out": ["output shapes", "output_shapes", "outputshape", "output shape", "args.output shapes"],
    "call_stack": ["call stack", "call_stack", "callstack", "stack", "args.call stack"],
    "op_type": ["op type", "op_type", "optype", "operator type", "args.op type"],
    "task_type": ["task type", "task_type", "tasktype", "args.task type"],
    "core_type": ["core type", "core_type", "coretype"],
    "flops": ["flops", "flop", "args.flops"],
    "wait_us": ["wait time", "wait_time", "wait time(us)", "args.wait time"],
    "device_id": ["device id", "device_id", "deviceid"],
    "stream": ["stream id", "stream_id", "streamid"],
    "rank": ["rank", "rank id", "rank_id", "args.rank"],
    "message": ["message", "msg", "domain", "args.message"],
    "token_count": ["num_tokens", "num tokens", "num_prompt_tokens", "num_generated_tokens", "batch_size"],
}

# Header spellings of each canonical table field, in order of precedence.
HEADERS = {
    "device_id": ["Device_id", "Device ID", "Device Id", "device_id", "Rank ID", "Rank_id"],
    "name": ["Name", "Op Name", "OP Name", "Operator Name", "Kernel Name", "Kernel_Name", "API Name", "kernel_name", "op_name"],
    "op_type": ["OP Type", "Op Type", "op_type", "OPType", "Operator Type", "Type"],
    "core_type": ["Accelerator Core", "Core Type", "core_type", "Core_Type", "Accelerator"],
    "task_type": ["Task Type", "task_type", "Task_Type"],
    "op_state": ["OP State", "Op State", "op_state"],
    "count": ["Count", "count", "Times", "Times(us)", "Call Count", "Total Count"],
    "total_us": ["Total Time(us)", "Total Time(ms)", "Total Duration(us)", "Total Duration(ms)", "Total Time", "total_time", "Time(us)"],
    "avg_us": ["Avg Time(us)", "Avg Time(ms)", "Average Time(us)", "Avg Duration(us)", "Avg Time", "avg_time", "Avg(us)"],
    "min_us": ["Min Time(us)", "Min Time(ms)", "Min Duration(us)"],
    "max_us": ["Max Time(us)", "Max Time(ms)", "Max Duration(us)"],
    "ratio_pct": ["Ratio(%)", "Ratio", "Proportion(%)", "Percentage(%)", "Ratio(%) of Total"],
    "start_us": ["Start Time(us)", "Start Time(ms)", "Task Start Time(us)", "Task Start Time(ms)", "Start_Time(us)", "Start_Time(ms)", "Start Time", "Start_Timestamp(us)", "Timestamp(us)", "start_time"],
    "dur_us": ["Device Total Duration(us)", "Device Self Duration(us)", "Duration(us)", "Duration(ms)", "Task Duration(us)", "Task Duration(ms)", "Duration", "Task_Duration(us)", "Elapse Time(us)", "Total Time(us)"],
    "host_total_us": ["Host Total Duration(us)", "Host Total Duration(ms)"],
    "host_self_us": ["Host Self Duration(us)", "Host Self Duration(ms)"],
    "device_self_us": ["Device Self Duration(us)", "Device Self Duration(ms)"],
    "wait_us": ["Wait Time(us)", "Wait Time(ms)", "Task Wait Time(us)", "Wait_Time(us)", "Wait Time"],
    "aicore_us": ["Device Self Duration With AICore(us)", "Device Total Duration With AICore(us)", "Aicore Time(us)", "Aicore Time(ms)", "AI Core Time(us)", "aicore_time(us)"],
    "block_dim": ["Block Dim", "Block_Dim", "Block Num", "block_dim"],
    "stream_id": ["Stream ID", "Stream_Id", "Stream Id", "stream_id"],
    "task_id": ["Task ID", "Task_Id", "task_id"],
    "step": ["Step", "Step Id", "Step_ID", "step", "Iteration", "Iteration Id"],
    "shapes_in": ["Input Shapes", "Input_Shapes", "input_shapes", "Input Shape", "Input Dims"],
    "shapes_out": ["Output Shapes", "Output_Shapes", "output_shapes", "Output Shape"],
    "call_stack": ["Call Stack", "Call_Stack", "call_stack", "Callstack"],
    "comm_group": ["Group Name", "Group_Name", "Comm Group", "Group"],
    "comm_size": ["Size(MB)", "Size(Bytes)", "Data Size(MB)", "Size"],
    "comm_bandwidth": ["Bandwidth(GB/s)", "Bandwidth", "SDMA Bandwidth(GB/s)"],
    "comm_type": ["Collective Type", "Communication Type", "OP Type", "Op Type"],
    "step_computing": ["Computing", "Computing(us)", "Computing Time(us)"],
    "step_comm": ["Communication", "Communication(us)", "Total Communication(us)"],
    "step_comm_not_overlapped": ["Communication(Not Overlapped)", "Communication (Not Overlapped)", "Communication Not Overlapped", "Not Overlapped Communication"],
    "step_overlapped": ["Overlapped", "Communication(Overlapped)", "Overlapped Communication"],
    "step_free": ["Free", "Free(us)", "Idle(us)"],
    "step_total": ["Total", "Total(us)", "Duration(us)", "Step Total(us)"],
    "step_stage": ["Stage"],
    "step_bubble": ["Bubble"],
    "step_preparing": ["Preparing"],
}
TEXT_FIELDS = {"device_id", "name", "op_type", "core_type", "task_type", "op_state", "stream_id", "task_id", "shapes_in", "shapes_out", "call_stack", "comm_group", "comm_type", "step_stage"}
STEP_FIELDS = ["step_computing", "step_comm", "step_comm_not_overlapped", "step_overlapped", "step_free", "step_total", "step_bubble", "step_preparing"]

# Table kinds by file name, in order; and the order in which kinds are believed.
TABLE_KINDS = [
    ("op_statistic", "op_?statistic"), ("api_statistic", "api_?statistic"), ("op_summary", "op_?summary"), ("kernel_details", "kernel_?details"), ("operator_details", "operator_?details|op_?details"),
    ("step_trace_time", "step_?trace_?time|step_?time"), ("communication_statistic", "communication_?(?:statistic|statics)|hccl_?statistic|comm_?statistic"), ("pipe_utilization", "pipe_?utilization|aic_?metrics|aicore_?metrics"),
]
KIND_PRIORITY = ["op_statistic", "op_summary", "kernel_details", "operator_details", "communication_statistic", "pipe_utilization", "generic", "api_statistic"]
METRIC_COLUMNS = [
    ("mac", "(?:^|_)mac(?:_|$)|cube_?ratio"), ("mte1", "mte1"), ("mte2", "mte2"), ("mte3", "mte3"), ("vec", "(?:^|_)vec(?:_|$)|vector_?ratio"), ("scalar", "scalar_?ratio|(?:^|_)scalar(?:_|$)"),
    ("fixpipe", "fixpipe"), ("aicore", "aicore_?utilization|aic_?utilization|core_?utilization"), ("icacheMiss", "icache_?miss"), ("hbm", "hbm_?(?:ratio|utilization|bandwidth)|ddr_?(?:ratio|utilization)"),
]
PLACEHOLDERS = ["", "n/a", "na", "null", "nan", "-", "--", "unknown"]

# Markers of artifacts (pattern, weight), on names, on content, and of the inference engine.
NAME_MARKERS = [
    (r"_ascend_pt($|/)", 4), ("ASCEND_PROFILER_OUTPUT", 4), ("mindstudio_profiler_output", 3), (r"(?:^|/)PROF_\d+", 3), (r"trace_view\.json$", 2), (r"kernel_details.*\.csv$", 3), (r"op_statistic.*\.csv$", 3),
    (r"op_summary.*\.csv$", 3), (r"operator_details.*\.csv$", 3), (r"step_trace_time.*\.csv$", 2), (r"communication_(?:statistic|matrix).*\.(?:csv|json)$", 2), (r"(?:profiler_info|profiler_metadata).*\.json$", 2),
    (r"mstx.*\.json$", 2), (r"api_statistic.*\.csv$", 2), (r"(?:memory_record|npu_module_mem).*\.csv$", 1), (r"aicore_freq.*\.csv$", 1), (r"analysis\.db$|\.db$", 1),
]
CONTENT_MARKERS = [
    ('"ascend"|ascend_profiler|torch_npu|cann', 3), (r'"device id"|\\?"stream id\\?"', 2), ("aicore|aicpu|mte1|mte2|mte3|fixpipe", 3), ("hccl|hcom_|allreduce|allgather|reducescatter", 2), ("aclrt|aclnn|acl_?memcpy", 2), ("npu|昇腾|华为", 1),
]
ENGINE_MARKERS = [
    ("vllm", 4), (r"execute_model|model_runner|model\.forward", 3), ("(?:^|[^a-z])(?:prefill|decode|chunked_prefill)(?:[^a-z]|$)", 3), ("kv[_-]?cache|block_?table|paged_attention|unified_attention", 3),
    ("tensor_parallel|tp_?group|world_?size|allreduce", 2), ("sampler|logits_processor|rejection_sampler", 1), ("quant|w8a8|int8|fp8|ascend_quant", 1),
]
LEAST_WEIGHT = 4

# Thresholds (value, relation).
THRESHOLDS = {
    "hostBusyGate": (45.0, ">="), "hostOnlyGate": (25.0, ">="), "deviceIdleSupport": (8.0, ">="), "dispatchPerStep": (1200.0, ">="), "hostExclusivePerStepUs": (800.0, ">="), "deviceBusyGate": (82.0, ">="),
    "computeShareGate": (55.0, ">="), "commExposedLow": (12.0, "<"), "macRatioComputeBound": (0.45, ">="), "mte2RatioMemoryBound": (0.45, ">="), "commShareGate": (12.0, ">="), "commExposedGate": (5.0, ">="),
    "commLatencyBoundUs": (60.0, "<="), "commBandwidthBoundMb": (16.0, ">="), "copyShareGate": (4.0, ">="), "hostCopyShareGate": (8.0, ">="), "d2hPerStepUs": (200.0, ">="), "gapShareGate": (10.0, ">="),
    "p95OverP50Gate": (2.0, ">="), "lowUtilizationGate": (0.3, "<"),
}
TRIGGER_SCORE = 40.0
MIN_GAP_US = 50.0
NOISE_PCT = 1.0

# Root causes (id, bottleneck, phase, condition over the indicators of a scope).
CAUSES = [
    ("host.eager-python-per-token", "host", "decode", "dispatchPerStep >= 400 and deviceBusyPct < 95"),
    ("host.sampler-sync", "host", "both", "hostSyncCount > 0 and (hostSyncPerStep >= 0.5 or hostSyncUs >= wallUs * 0.03)"),
    ("host.prefill-metadata", "host", "prefill", "hostOnlyPct >= 15 and dispatchPerStep >= 300"),
    ("host.launch-gaps", "host", "both", "gapCount >= 5 and meanGapUs >= 80 and idlePct >= 5"),
    ("compute.prefill-attention-quadratic", "compute", "prefill", "computePct >= 55 and hasAttention"),
    ("compute.decode-memory-bound", "compute", "decode", "deviceBusyPct >= 70 and (mac is null or mac < 0.35) and (mte2 is null or mte2 >= 0.25)"),
    ("compute.fragmented-small-ops", "compute", "both", "deviceBusyPct >= 70 and computePct >= 40 and medianComputeUs > 0 and medianComputeUs < 30"),
    ("comm.decode-tp-small-message", "comm", "decode", "commPctOfDevice >= 12 and commLatencyMedianUs <= 120"),
    ("comm.prefill-bandwidth", "comm", "prefill", "commPctOfDevice >= 12 and (commSizeMedianMb is null or commSizeMedianMb >= 1)"),
    ("comm.overlap-disabled", "comm", "both", "commPctOfDevice >= 8 and commOverlapPct < 40"),
    ("copy.d2h-sync-sampling", "copy", "both", "d2hPerStepUs >= 150 or hostSyncCount > 0"),
    ("copy.h2d-kv-or-weight", "copy", "both", "h2dPerStepUs >= 200"),
]

# Advice (id, bottleneck, phase, level 1 to 3, condition, expected gain in percent, lower end of the gain).
ADVICE = [
    ("host.enable-graph-mode", "host", "decode", 3, "phase = 'decode' and hostOnlyPct >= 15 and dispatchPerStep >= 300", "100 * case when avgStepUs > 0 then least(0.8, hostExclusivePerStepUs * 0.75 / avgStepUs) else 0 end", None),
    ("host.async-sampling", "host", "both", 3, "hostSyncCount > 0 and (hostSyncPerStep >= 0.5 or hostSyncUs >= 50)", "80 * case when avgStepUs > 0 then least(0.5, hostSyncUs / greatest(1, stepCount) / avgStepUs) else 0 end", None),
    ("host.reduce-dispatch", "host", "both", 2, "dispatchPerStep >= 800", "least(40, hostBusyPct * 0.35)", "least(40, hostBusyPct * 0.15)"),
    ("compute.quantize", "compute", "prefill", 3, "phase = 'prefill' and computePct >= 50", "30", "20"),
    ("compute.decode-increase-batch", "compute", "decode", 3, "phase = 'decode' and deviceBusyPct >= 70 and (mac is null or mac < 0.4)", "least(60, greatest(0, 100 - deviceBusyPct) + 15)", None),
    ("compute.fuse-small-ops", "compute", "both", 2, "deviceBusyPct >= 70 and medianComputeUs > 0 and medianComputeUs < 40", "20", "10"),
    ("compute.tune-chunked-prefill", "compute", "prefill", 2, "phase = 'prefill' and stepCount >= 2", "12", "5"),
    ("comm.enable-overlap-fusion", "comm", "both", 3, "commPctOfDevice >= 10 and commOverlapPct < 60", "100 * case when avgStepUs > 0 then least(0.6, commExposedUs / greatest(1, stepCount) * 0.6 / avgStepUs) else 0 end", None),
    ("comm.batch-amortize", "comm", "decode", 3, "phase = 'decode' and commLatencyMedianUs <= 120", "least(45, 70 * case when avgStepUs > 0 then commUsPerStep / avgStepUs else 0 end)", None),
    ("comm.parallel-strategy", "comm", "both", 2, "commPctOfDevice >= 20", "15", "5"),
    ("copy.async-d2h", "copy", "both", 3, "d2hPerStepUs >= 100 or (hostCopyPctOfHost >= 5 and hostSyncCount > 0)", "100 * case when avgStepUs > 0 then least(0.3, d2hPerStepUs * 0.7 / avgStepUs) else 0 end", None),
    ("copy.kv-locality", "copy", "both", 2, "h2dPerStepUs >= 150", "100 * case when avgStepUs > 0 then least(0.25, h2dPerStepUs * 0.8 / avgStepUs) else 0 end", None),
    ("copy.reduce-profiling-overhead", "copy", "both", 1, "hostSyncCount > 0 and hostSyncUs >= wallUs * 0.05", "5", "2"),
    ("common.phase-isolation", "balanced", "both", 2, "phaseMix and phaseConfidence = 'low'", "0", None),
    ("common.collect-richer-profile", "balanced", "both", 2, "mac is null or missingTables", "0", None),
]
ADVICE_TARGETS = {
    "host.enable-graph-mode": ["dispatchPerStep", "hostExclusivePerStepUs", "avgStepUs"], "host.async-sampling": ["hostSyncPerStep", "avgStepUs"], "host.reduce-dispatch": ["dispatchPerStep", "hostScheduleUs"],
    "host.smooth-sampling-path": ["hostSyncPerStep"], "compute.quantize": ["computeUs"], "compute.decode-increase-batch": ["avgStepUs", "commPerStep"], "compute.fuse-small-ops": ["computeUs", "dispatchPerStep"],
    "compute.tune-chunked-prefill": ["avgStepUs"], "comm.enable-overlap-fusion": ["commExposedPct", "commOverlapPct"], "comm.batch-amortize": ["commUsPerStep", "commPerStep"],
    "comm.parallel-strategy": ["commExposedPct", "commUsPerStep"], "copy.async-d2h": ["d2hPerStepUs"], "copy.kv-locality": ["d2hPerStepUs", "copyUs"], "copy.reduce-profiling-overhead": ["avgStepUs", "hostBusyPct"],
}

# Comparison metrics and the direction in which each is better.
METRICS = [
    ("avgStepUs", "lower"), ("wallUs", "lower"), ("deviceBusyPct", "higher"), ("idlePct", "lower"), ("hostExclusivePerStepUs", "lower"), ("hostOnlyPct", "lower"), ("hostBusyPct", "lower"), ("hostScheduleUs", "lower"),
    ("dispatchPerStep", "lower"), ("hostSyncPerStep", "lower"), ("commExposedPct", "lower"), ("commOverlapPct", "higher"), ("commUsPerStep", "lower"), ("commPerStep", "neutral"), ("copyUs", "lower"), ("d2hPerStepUs", "lower"),
    ("h2dPerStepUs", "lower"), ("computeUs", "lower"), ("computePct", "neutral"), ("meanGapUs", "lower"), ("gapCount", "lower"), ("eventCount", "neutral"), ("deviceEventCount", "neutral"),
]
#: What each metric is called in reports, and its group.
METRIC_TEXT = {
    "avgStepUs": ("mean step", "overview"), "wallUs": ("captured window", "overview"), "deviceBusyPct": ("device busy", "overview"), "idlePct": ("device idle", "overview"), "hostExclusivePerStepUs": ("host alone per step", "host"),
    "hostOnlyPct": ("host alone", "host"), "hostBusyPct": ("host busy", "host"), "hostScheduleUs": ("host scheduling operators", "host"), "dispatchPerStep": ("operators dispatched per step", "host"), "hostSyncPerStep": ("synchronising operators per step", "host"),
    "commExposedPct": ("communication not hidden", "communication and copies"), "commOverlapPct": ("communication under compute", "communication and copies"), "commUsPerStep": ("communication per step", "communication and copies"),
    "commPerStep": ("communications per step", "communication and copies"), "copyUs": ("device copies", "communication and copies"), "d2hPerStepUs": ("copies to the host per step", "communication and copies"),
    "h2dPerStepUs": ("copies to the device per step", "communication and copies"), "computeUs": ("device compute", "device"), "computePct": ("compute of the window", "device"), "meanGapUs": ("mean idle span", "device"),
    "gapCount": ("idle spans", "device"), "eventCount": ("events", "size"), "deviceEventCount": ("device events", "size"),
}
#: Advice that asks for a better capture only.
CONFIDENCE_ADVICE = ["common.phase-isolation", "common.collect-richer-profile"]
#: Measures that made a cause apply, by the bottleneck that its name begins with: (measure, condition to be told).
TRIGGERS = {
    "host": [("hostOnlyPct", None), ("idlePct", None), ("dispatchPerStep", None), ("hostExclusivePerStepUs", None), ("hostSyncCount", "hostSyncCount > 0"), ("gapCount", "gapCount > 0")],
    "compute": [("deviceBusyPct", None), ("computePct", None), ("mac", None), ("mte2", None), ("commExposedPct", None)],
    "comm": [("commPctOfDevice", None), ("commExposedPct", None), ("commOverlapPct", None), ("commLatencyMedianUs", None), ("commPerStep", None), ("commSizeMedianMb", "commSizeMedianMb is not null")],
    "copy": [("copyPct", None), ("hostCopyPctOfHost", None), ("d2hPerStepUs", None), ("h2dPerStepUs", None), ("hostSyncCount", "hostSyncCount > 0")],
}
#: Measures of the evidence table, by group.
EVIDENCE = [
    ("time", ["wallUs", "deviceBusyPct", "hostBusyPct", "idlePct", "hostOnlyPct"]), ("operators", ["computePct", "commPct", "commExposedPct", "copyPct", "hostScheduleUs"]), ("steps", ["avgStepUs", "dispatchPerStep"]), ("utilisation", ["mac", "mte2"]),
]


def unit_of(metric: str) -> str:
    """Unit of a measure, by its name."""
    return "%" if "Pct" in metric else "us" if metric.endswith("Us") else "MB" if metric.endswith("Mb") else ""


def pattern(words: list[tuple[str, str, str]], subtype: str | None = None) -> str:
    """Case-insensitive regular expression of a vocabulary, or of one of its subtypes; the same in Java and RE2."""
    parts = [f"(?:^|[^a-z])(?:{w})(?:[^a-z]|$)" if where == "bounded" else f"(?:{w})" for name, where, w in words if subtype in (None, name)]
    return "(?i)" + "|".join(parts)
