"""Service dimension: raw service name -> display label."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The cloud-cost service labels of the reference dashboard
# (raw name -> label), in the reference's order.
DEFAULT_SERVICE_MAP: tuple[tuple[str, str], ...] = (
    ("AWS Cloud Map", "Cloud Map"),
    ("AWS CloudShell", "CloudShell"),
    ("AWS CloudTrail", "CloudTrail"),
    ("AWS Config", "Config"),
    ("AWS Cost Explorer", "Cost Explorer"),
    ("AWS Glue", "Glue"),
    ("AWS IoT", "IoT"),
    ("AWS IoT Device Management", "IoT Device Management"),
    ("AWS Key Management Service", "KMS"),
    ("AWS Lambda", "Lambda"),
    ("AWS Payment Cryptography", "Payment Cryptography"),
    ("AWS Secrets Manager", "Secrets Manager"),
    ("AWS Security Hub", "Security Hub"),
    ("AWS Step Functions", "Step Functions"),
    ("AWS Support (Developer)", "Support (Developer)"),
    ("AWS Systems Manager", "Systems Manager"),
    ("AWS WAF", "WAF"),
    ("AWS X-Ray", "X-Ray"),
    ("Amazon API Gateway", "API Gateway"),
    ("Amazon Athena", "Athena"),
    ("Amazon CloudFront", "CloudFront"),
    ("Amazon DocumentDB (with MongoDB compatibility)", "DocumentDB"),
    ("Amazon DynamoDB", "DynamoDB"),
    ("Amazon EC2 Container Registry (ECR)", "ECR"),
    ("Amazon Elastic Compute Cloud - Compute", "EC2"),
    ("Amazon Elastic Container Service", "ECS"),
    ("Amazon Elastic File System", "EFS"),
    ("Amazon Elastic Load Balancing", "ELB"),
    ("Amazon GuardDuty", "GuardDuty"),
    ("Amazon Inspector", "Inspector"),
    ("Amazon Kinesis", "Kinesis"),
    ("Amazon Kinesis Firehose", "Firehose"),
    ("Amazon Location Service", "Location Service"),
    ("Amazon Macie", "Macie"),
    ("Amazon Relational Database Service", "RDS"),
    ("Amazon Route 53", "Route 53"),
    ("Amazon Simple Notification Service", "SNS"),
    ("Amazon Simple Storage Service", "S3"),
    ("Amazon Simple Queue Service", "SQS"),
    ("Amazon Timestream", "Timestream"),
    ("Amazon Virtual Private Cloud", "VPC"),
    ("AmazonCloudWatch", "CloudWatch"),
    ("CloudWatch Events", "CloudWatch Events"),
    ("EC2 - Other", "EC2 - Other"),
    ("Tax", "Tax"),
)


def service_map_frame(
    spark: SparkSession,
    pairs: Mapping[str, str] | tuple[tuple[str, str], ...] = DEFAULT_SERVICE_MAP,
) -> DataFrame:
    """Seed the dimension from literal pairs; of a raw name given twice the last label counts."""
    items = dict(pairs.items() if isinstance(pairs, Mapping) else pairs)
    return spark.createDataFrame(list(items.items()), "raw string, label string")
