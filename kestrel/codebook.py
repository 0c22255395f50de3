"""Label books and fixed text values.

FIXED VALUES: the strings and orders below must equal the originals for
results to match (class codes, display names, field names). They are stated
plainly, in their natural order, and are not derived from anything.
"""

# --- fixed values ---------------------------------------------------------

# posting label code -> English name (raw CSV form)
LABEL_NAMES = ["clean", "warning", "seeding"]
# aspect polarity code -> English name (raw CSV form)
ASPECT_CLASS_NAMES = ["neutral", "positive", "negative", "not_mentioned"]
# the four aspects, in column order
ASPECTS = ["title", "desc", "company", "other"]
ASPECT_COLUMNS = ["title_aspect", "desc_aspect", "company_aspect", "other_aspect"]
# columns of the aspect task's output
ASPECT_OUTPUTS = ["predicted_title", "predicted_desc", "predicted_comp", "predicted_other"]

# Vietnamese decode maps used when verbalising predictions
LABEL_NAMES_VI = {0: "rõ ràng", 1: "cảnh báo", 2: "có yếu tố thu hút"}
ASPECT_CLASS_NAMES_VI = {0: "trung tính", 1: "tích cực", 2: "tiêu cực", 3: "không đề cập"}
# prefixes of the verbalised aspects and label, in output order
VERBALISE_PREFIXES = ["khía cạnh tiêu đề", "khía cạnh mô tả", "khía cạnh công ty",
                      "khía cạnh khác", "nhãn chung"]

# offline assembly: feature names by position (21 names)
OFFLINE_FIELD_NAMES = [
    "tiêu đề", "ngành nghề",
    "mô tả", "kinh nghiệm", "học vấn", "bằng cấp", "quyền lợi",
    "tên công ty", "địa chỉ", "số điện thoại", "người liên hệ",
    "số lượng tuyển", "hình thức hợp đồng", "hình thức trả lương", "lương tối thiểu",
    "lương tối đa", "giới tính", "năm sinh", "tuổi", "tuổi thấp nhất", "tuổi cao nhất",
]

# online layout: column groups in output order
LAYOUT_GROUPS = [
    ["title", "job_type"],
    ["body", "education", "experience", "certification", "benefit"],
    ["company_name", "location", "phone", "contact_name"],
    ["vacancy", "total_image", "salary_type", "min_salary", "max_salary", "gender",
     "year_of_birth", "age", "min_age", "max_age"],
]

# online layout: English column -> display name
DISPLAY_NAMES = {
    "title": "Tiêu đề", "body": "Mô tả", "location": "địa chỉ",
    "phone": "Số điện thoại liên lạc", "contact_name": "Tên liên lạc",
    "job_type": "Loại hình công việc", "education": "Học vấn tối thiểu",
    "experience": "Kinh nghiệm", "certification": "Chứng chỉ, kỹ năng",
    "benefit": "Các quyền lợi khác", "company_name": "Tên công ty",
    "vacancy": "Số lượng tuyển dụng", "salary_type": "Hình thức trả lương",
    "year_of_birth": "Năm sinh", "gender": "Giới tính", "age": "Độ tuổi",
    "min_age": "Độ tuổi tối thiểu", "max_age": "Độ tuổi tối đa",
    "min_salary": "Lương tối thiểu", "max_salary": "Lương tối đa",
}

# crawled posting with its poster: column groups in output order (spelled as in the original)
CRAWLED_GROUPS = [
    ["title", "Ngành nghề"],
    ["body", "Học vấn tối thiểu", "Kinh nghiệm", "Chứng chỉ, kỹ năng", "Các quyền lợi khác"],
    ["Tên công ty", "location", "phone", "contact_name"],
    ["ID người đăng", "Tên người đăng", "Số điện thoại người đăng", "URL người đăng",
     "publish_at", "submisson_expired", "is_anonymous", "is_recruiters"],
    ["id", "url", "Số lượng tuyển dụng", "total_image", "Loại hình công việc", "Hình thức trả lương",
     "Lương tối thiểu", "Lương tối đa", "Giới tính", "Độ tuổi"],
]

# crawled posting: column -> display name, where the original's rename applies
CRAWLED_NAMES = {
    "title": "Tiêu đề", "body": "Mô tả", "location": "địa chỉ", "phone": "Số điện thoại liên lạc",
    "is_anonymous": "Là người lạ", "is_recruiters": "Là người tuyển dụng", "total_image": "Số lượng ảnh",
}

# names of the six poster columns left after the drop, by position
POSTER_NAMES = ["ID người đăng", "Tên người đăng", "Số điện thoại người đăng", "URL người đăng",
                "u.created_date", "u.ad_id"]

# poster columns dropped before the join, and the poster column names after it
POSTER_DROP = ["microsite", "total", "post_hidden_phone", "post_hidden_microsite",
               "reputation", "image_url"]

# special tokens
CLS_TOKEN = "[CLS]"
SEP_TOKEN = "[SEP]"
TOKEN_PROFILES = {
    "bert": {},                                   # unchanged
    "roberta": {"[CLS]": "<s>", "[SEP]": "</s>"},
    "no_cls": {"[CLS]": ""},
}

# salary display text
SALARY_NEGOTIABLE = "Thỏa thuận"
SALARY_FROM = "Từ"
SALARY_TO = "Đến"
SALARY_AMOUNT_PATTERN = r"\d{1,3}(?:\.\d{3})*"

# posting URL
POSTING_ID_PATTERN = r"-id(\d+)"

# smoothing constant of the smoothed aspect metrics (float64 machine epsilon)
EPS = 2.220446049250313e-16

# default training cadence: trigger rows, replay multiple, mini-batch, epochs
TRIGGER_ROWS = 128
REPLAY_EVERY = 4
MINI_BATCH = 32
EPOCHS = 5
EARLY_STOP_PATIENCE = 5
