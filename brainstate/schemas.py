"""Declared schemas; readers never infer."""

SAMPLES = "session_id string, sample_idx long, ts timestamp, ch array<float>"
CUES = "session_id string, sample_idx long, code string"
METRICS = (
    "session_id string, ts timestamp, theta double, alpha double, beta double, fatigue_idx double, "
    "focus_idx double, calm_idx double, happy_idx double, distress_idx double"
)
EEG_MEMORY = "session_id string, evt_id string, embedding array<double>, context string, ts timestamp"
TEXT_MEMORY = "session_id string, evt_id string, document string, context string, ts timestamp"
MESSAGES = "session_id string, turn long, role string, text string"
CHAT_STORE = (
    "chat_sessions map<string, struct<title: string, messages: array<struct<role: string, content: string>>>>, "
    "session_counter int, current_session_id string"
)
