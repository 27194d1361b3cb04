"""Published fold results and summaries of four models, and the
confusion matrices that explain them (classes A and B, AB = true A, predicted B)."""

FOLDS_HEADER = (
    "model", "K", "fold", "AA", "AB", "BA", "BB", "train_n", "val_n", "test_n",
    "accuracy", "f1_macro", "precision_macro", "recall_macro",
    "runtime", "rows_per_second", "steps_per_second", "train_seconds", "test_seconds",
)

FOLDS = """
BERT 1 1 262 6 3 54 1040 260 325 0.9723076923076923 0.9530956848030019 0.9443396226415095 0.9624901806755695 13.9742 23.257 1.503 952.9731619358063 13.980458974838257
BERT 3 1 261 7 1 56 866 434 325 0.9753846153846154 0.9591194968553459 0.9425360474978796 0.9781683686829012 13.7701 23.602 1.525 491.3636691570282 13.772868871688843
BERT 3 2 264 4 2 55 867 433 325 0.9815384615384616 0.9685199535063929 0.9623422964190136 0.974993453783713 13.6214 23.859 1.542 469.7105119228363 13.624380350112915
BERT 3 3 262 6 2 55 867 433 325 0.9753846153846154 0.9585828979227731 0.9470317933432688 0.9712621105001309 15.0476 21.598 1.396 478.2932131290436 15.053522109985352
RoBERTa 1 1 265 3 4 53 1040 260 325 0.9784615384615385 0.9625088577973335 0.9657793414763675 0.9593152657763813 20.0909 16.176 1.045 957.0669949054718 20.099289894104004
RoBERTa 3 1 266 2 9 48 866 434 325 0.9661538461538461 0.938469217397291 0.9636363636363636 0.9173212882953652 44.4983 7.304 0.472 916.1222679615021 44.52681922912598
RoBERTa 3 2 265 3 4 53 867 433 325 0.9784615384615385 0.9625088577973335 0.9657793414763675 0.9593152657763813 21.4973 15.118 0.977 845.215824842453 21.499556064605713
RoBERTa 3 3 265 3 5 52 867 433 325 0.9753846153846154 0.9568507700477961 0.9634680134680135 0.9505433359518198 30.3484 10.709 0.692 970.1629428863525 30.387423038482666
BART 1 1 266 2 4 53 1040 260 325 0.9815384615384616 0.9676380775358471 0.9744107744107744 0.9611809374181723 35.5113 9.152 0.591 1271.9744608402252 35.548938035964966
BART 3 1 266 2 5 52 866 434 325 0.9784615384615385 0.961974962 0.9722563892305589 0.9524090075936109 25.9953 12.502 0.808 1227.651295185089 26.030618906021118
BART 3 2 267 1 3 54 867 433 325 0.9876923076923076 0.978425385 0.9853535353535354 0.9718185388845247 23.5184 13.819 0.893 1126.7284610271454 23.535505771636963
BART 3 3 267 1 3 54 867 433 325 0.9876923076923076 0.978425385 0.9853535353535354 0.9718185388845247 23.5285 13.813 0.893 1128.6304230690002 23.55218195915222
T5 1 1 265 3 2 55 1040 260 325 0.9846153846153847 0.9735879723689558 0.9703926126824228 0.9768591254255041 211.0342 1.54 0.194 10455.27369093895 211.05088877677917
T5 3 1 265 3 4 53 866 434 325 0.9784615384615385 0.9625088577973335 0.9657793414763675 0.9593152657763813 233.5346 1.392 0.176 9203.860555887222 233.56791520118713
T5 3 2 268 0 4 53 867 433 325 0.9876923076923076 0.9781144781144782 0.9926470588235294 0.9649122807017544 240.9569 1.349 0.17 8563.248344898224 240.97426199913025
T5 3 3 264 4 2 55 867 433 325 0.9815384615384616 0.9685199535063929 0.9623422964190136 0.974993453783713 182.86 1.777 0.224 9783.972353935242 182.89577293395996
"""

SUMMARY_HEADER = (
    "model", "K", "accuracy_mean", "accuracy_std", "f1_macro_mean", "f1_macro_std",
    "precision_macro_mean", "precision_macro_std", "recall_macro_mean", "recall_macro_std",
    "train_seconds_mean", "train_seconds_std", "test_seconds_mean", "test_seconds_std",
)

SUMMARY = """
BERT 1 0.9723076923076923 - 0.9530956848030019 - 0.9443396226415095 - 0.9624901806755695 - 952.9731619358063 - 13.980458974838257 -
BERT 3 0.9774358974358974 0.003552924733474625 0.9620741160948373 0.005588702850909759 0.950636712420054 0.010383566595544496 0.9748079776555817 0.0034568629662383864 479.78913140296936 10.903812781034807 14.150257110595703 0.7857658395487408
RoBERTa 1 0.9784615384615385 - 0.9625088577973335 - 0.9657793414763675 - 0.9593152657763813 - 957.0669949054718 - 20.099289894104004 -
RoBERTa 3 0.9733333333333333 0.006405126152203504 0.9526096150808069 0.012568477403064859 0.9642945728602482 0.0012885995605134391 0.942393296674522 0.0221515437686664 910.5003452301025 62.66298818495182 32.137932777404785 11.613006736912014
BART 1 0.9815384615384616 - 0.9676380775358471 - 0.9744107744107744 - 0.9611809374181723 - 1271.9744608402252 - 35.548938035964966 -
BART 3 0.9846153846153847 0.005329387100211893 0.9729419106742526 0.009497656175586408 0.98098781997921 0.007561640839716359 0.9653486951208867 0.011206098115653524 1161.003393093745 57.72661002332649 24.372768878936768 1.4357644507492158
T5 1 0.9846153846153847 - 0.9735879723689558 - 0.9703926126824228 - 0.9768591254255041 - 10455.27369093895 - 211.05088877677917 -
T5 3 0.9825641025641025 0.004700077635852097 0.9697144298060681 0.007871081666047166 0.9735895655729702 0.016593503440440298 0.9664070000872829 0.00794525231376674 9183.693751573563 610.6118255954608 219.14598337809244 31.61126082831511
"""


def table(header, text):
    """Rows as dicts; numbers as float, ``-`` as None."""

    def value(v):
        if v == "-":
            return None
        try:
            return float(v)
        except ValueError:
            return v

    return [dict(zip(header, map(value, line.split()), strict=True)) for line in text.strip().splitlines()]
