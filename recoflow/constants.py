"""Fixed values that must equal the original system's for identical results.

Kept together, in their natural order, as plain text.
"""

# ---- fixed values: subscriber line cleaning ---------------------------------
# msisdn prefix rewrite (first occurrence, only when the msisdn starts with it)
MSISDN_OLD_PREFIX = "8416"
MSISDN_NEW_PREFIX = "843"
# brand tokens removed from every offer, literally, all occurrences, in this order
BRAND_TOKENS = ["MOBILE-", "MOBILE- ", "MOBILE_"]
# offers starting with any of these are dropped (after brand-token removal)
OFFER_FILTER = ["PCRF", "HOME", "MONG", "MUONG"]

# ---- fixed values: keys ------------------------------------------------------
# a user key above this is an msisdn, otherwise a dense user id
MSISDN_THRESHOLD = 100000000

# ---- fixed values: evaluation ------------------------------------------------
K_SWEEP = [3, 5, 7, 9, 11, 13]
COVERAGE_SHARES = [0.05, 0.2, 0.5]
TOP_ITEMS_REPORTED = 5
HELDOUT_TOP_K = 10
LOG_LOSS_EPS = 1e-7

# ---- fixed values: model defaults --------------------------------------------
RDD_ALS_RANK = 8
RDD_ALS_REG_GRID = [0.07, 0.09]
RDD_ALS_ITERATIONS = 20
RDD_ALS_ALPHA = 16.0
CONF_ALS_ALPHA = 28.0
CONF_ALS_FACTORS = 8
CONF_ALS_REG = 1.05
CONF_ALS_ITERATIONS = 100
POINTWISE_NEGATIVES = 2
POINTWISE_FACTOR_DIM = 8

# ---- fixed values: message vocabulary ----------------------------------------
MESSAGE_TYPE_ONLINE_REQUEST = "1"
MESSAGE_TYPE_ONLINE_RESPONSE = "2"
MESSAGE_TYPE_ONLINE_STATUS = "3"
MESSAGE_TYPE_ONLINE_WARNING = "4"
MESSAGE_TYPE_OFFLINE_REQUEST = "1001"
MESSAGE_TYPE_OFFLINE_RESPONSE = "1002"
MESSAGE_TYPE_OFFLINE_STATUS = "1003"
MESSAGE_TYPE_OFFLINE_WARNING = "1004"

GROUP_ID_CBA360 = "cba360"
GROUP_ID_PREPROCESSING = "preprocessing"
GROUP_ID_SEGMENTATION = "segmentation"
GROUP_ID_INACTIVE = "inactive"
GROUP_ID_RECOMMENDER = "recommender"
GROUP_ID_CAMPAIGN = "campaign"

PROCESS_ID_RECOMMENDER_PRE = "recommender_preprocessing"
PROCESS_ID_RECOMMENDER_TRAINING = "recommender_training"
PROCESS_ID_RECOMMENDER_DEPLOY = "recommender_deploy"
PROCESS_ID_RECOMMENDER_PREDICT = "recommender_predict"
PROCESS_ID_RECOMMENDER_EVALUATE = "recommender_evaluate"

# the whole vocabulary: anything else is quarantined
MESSAGE_TYPES = ["1", "2", "3", "4", "1001", "1002", "1003", "1004"]
GROUP_IDS = ["cba360", "preprocessing", "segmentation", "inactive", "recommender", "campaign"]
PROCESS_IDS = ["accum", "query", "filter_segment", "recommender_preprocessing", "inactive_preprocessing", "inactive_sampling",
               "segment", "inactive_training", "inactive_deploy", "inactive_predict", "inactive_evaluate",
               "recommender_training", "recommender_deploy", "recommender_predict", "recommender_evaluate",
               "creation", "execution", "interation", "evaluation", "visualization"]

STATUS_ACCEPTED = "ACCEPTED"
STATUS_RUNNING = "RUNNING"
STATUS_FINISHED = "FINISHED"
STATUS_SEQUENCE = [STATUS_ACCEPTED, STATUS_RUNNING, STATUS_FINISHED]

TOPIC_PROCESS_STATUS = "cba_process_status"
TOPIC_REQUEST = "cba_request"
TOPIC_RESPONSE = "cba_response"

CONTENT_KEY_MSISDN_LIST = "list_msisdn"
CONTENT_KEY_NUM_ITEMS = "num_recommend_item"
CONTENT_KEY_RESULT = "table_recommendation_item"
