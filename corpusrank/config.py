"""Run options.  One dataclass, plain defaults, no presets."""

from __future__ import annotations

from dataclasses import dataclass, field, asdict


@dataclass(frozen=True)
class Options:
    # corpus
    text_col: str = "text"
    label_col: str = "label"
    id_col: str = "doc_id"
    max_docs: int = 0                # 0 = no cap
    seed: int = 42
    make_binary: bool = True
    pos_class: int = 0

    # cross-validation
    outer_folds: int = 2
    inner_val_size: float = 0.1

    # text normalisation
    keep_placeholders: bool = False

    # TF-IDF / LSA
    tfidf_max_features: int = 0      # 0 = every term with df >= min_df
    tfidf_ngram_max: int = 2
    tfidf_min_df: int = 2
    tfidf_stop_words: bool = True
    lsa_dim: int = 128
    # Fixed value: the vocabulary of the LSA representation
    lsa_max_features: int = 60000

    # Word2Vec (Spark's trainer: no negative-sampling / CBOW switch)
    w2v_dim: int = 50
    w2v_window: int = 5
    w2v_min_count: int = 2
    w2v_epochs: int = 2
    w2v_max_train_docs: int = 0      # 0 = all documents
    w2v_max_tokens_per_doc: int = 0  # 0 = whole texts
    w2v_partitions: int = 4          # part of the result, so not taken from the cluster

    # models
    # Iteration limits and boosting rounds of the reference's models
    logreg_max_iter: int = 3000
    svm_max_iter: int = 1000
    gbt_max_iter: int = 200
    gbt_exact_max_iter: int = 100

    # overfit rule
    enable_overfit_flag: bool = True
    overfit_acc_gap_thr: float = 0.1

    # winner selection
    primary_metric: str = "val_pr_auc"
    tie_metrics: tuple = ("val_roc_auc", "val_f1", "val_mcc", "val_bal_acc", "val_acc")
    tie_eps: float = 1e-6

    # metrics
    n_bins: int = 15
    error_top_k: int = 200

    # retrieval
    topk_k: int = 20
    topk_theta: float = 0.01
    topk_history_size: int = 10
    topk_use_real_time: bool = False
    # documents of the newest window and of one broadcast part; users up to whom
    # the users are the broadcast side
    topk_block_docs: int = 4096
    topk_block_users: int = 1024

    # fits of the grid that run at once
    parallelism: int = 8

    # grid switches
    run_w2v: bool = True
    w2v_only_for_model: str = "logreg"
    reps: tuple = ("tfidf_lsa", "w2v_avg")
    models: tuple = ("logreg", "linearsvc", "gbt")

    def to_dict(self) -> dict:
        return asdict(self)

    def replace(self, **kw) -> "Options":
        d = self.to_dict()
        d.update(kw)
        return Options(**d)


DEFAULT = Options()
