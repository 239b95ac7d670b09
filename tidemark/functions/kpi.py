"""Fixed values shared by every pipeline."""

# KPI names, split ratios and model settings.
KPIS = ["bandwidth", "throughput", "congestion", "packet_loss", "latency", "jitter"]
LABEL = "anomaly"
TIMESTAMP = "timestamp"
ALERT_QUANTILE = 0.99
TRAIN_RATIO, VAL_RATIO = 0.70, 0.15
CV_FOLDS = 3
INCIDENT_GAP_ROWS = 0
TOP_SHARES = (0.01, 0.02, 0.05, 0.1)
