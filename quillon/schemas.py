"""Canonical tables."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields):
    return StructType([StructField(k, v) for k, v in fields.items()])


S, D, I, L = StringType(), DoubleType(), IntegerType(), LongType()

RESPONSE = _struct(item=S, channel=S, channel_ord=I, response=D)
ITEM_META = _struct(item=S, name=S, cas=S, formula=S, molecular_weight=D, smiles=S, synonyms=S)
#: Connection files, as they are written: source, middle and target of each two-step path.
PATHWAY_FILE = _struct(
    orn_root_id=S, orn_label=S, orn_glomerulus=S, level1_root_id=S, level1_cell_type=S, level1_category=S, level2_root_id=S, level2_cell_type=S, level2_category=S, synapse_count_step1=I, synapse_count_step2=I
)
PATHWAY_NAMES = dict(zip(PATHWAY_FILE.names, "source source_label source_region middle middle_type middle_class target target_type target_class step1 step2".split()))
REGION_MATRIX_FILE = _struct(source_glom=S, target_glom=S, synapse_count_step2=I)
LABELS = _struct(root_id=S, label=S, supervoxel_id=S, x=D, y=D, z=D)
ALIAS_FILE = _struct(common_name=S, inchikey=S, alternative_names=S)
